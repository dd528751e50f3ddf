"""Findings as streams: changed files against a snapshot, new findings against a baseline, and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tracewell.operators import incremental
from tracewell.sources import baselines


def watch_files(files: DataFrame, snapshot_path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Calls on_change(changed files, batch) with the files of each micro-batch whose content is new, then updates the snapshot.

    files: a stream (path, content). A batch that repeats after a failure finds its files unchanged or does the same again:
    the snapshot is written beside the old one and moved by a version number, so no reader sees half of it.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.dropDuplicates(["path"])
        now = incremental.snapshot(latest)
        before = _snapshot(spark, snapshot_path)
        changed = now.join(before, ["path", "content_hash"], "left_anti")
        on_change(latest.join(changed.select("path"), "path", "left_semi"), number)
        merged = before.join(now.select("path"), "path", "left_anti").unionByName(now)
        merged.withColumn("version", F.lit(baselines.VERSION)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{snapshot_path}/batch={number:09d}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _snapshot(spark, path: str) -> DataFrame:
    """The snapshot of the last batch."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max((s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().startswith("batch=")), default=None) if fs.exists(where) else None
    return baselines.load_snapshot(spark, f"{path}/{last}") if last else spark.createDataFrame([], "path string, content_hash string")


def only_new(issues: DataFrame, baseline: DataFrame, on: str = "fingerprint") -> DataFrame:
    """A stream of issues without those of a fixed baseline."""
    return issues.join(baseline.select(on).distinct(), on, "left_anti")


def counted(issues: DataFrame, time: str = "ts", late: str = "1 minute", width: str = "10 seconds") -> DataFrame:
    """Findings by engine and window of event time; rows later than the watermark are left out."""
    return issues.withWatermark(time, late).groupBy(F.window(time, width), "engine").agg(F.count("*").alias("findings"))


class Progress(StreamingQueryListener):
    """Keeps the last events of a query: batch, rows and rows a second."""

    def __init__(self, keep: int = 5):
        self.keep, self.recent, self.rows = keep, [], 0

    def onQueryStarted(self, event) -> None:
        self.recent.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += p.numInputRows
        self.recent = [*self.recent, (p.batchId, p.numInputRows, p.processedRowsPerSecond)][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
