"""Reading tables, and the helpers that every corpus operator shares."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of the held-out rule: a document is held out if crc32(doc_id as text) mod FOLDS is 0.
FOLDS = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True if the document must not be learnt from. A null id is not held out, yet never learnt from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def trainable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS != 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one in the warehouse of a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/_corpus_scratch"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by checkpoint() in the shared folder, so later jobs neither repeat the work nor depend on an executor."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts(batch: pa.RecordBatch, rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices, of fewer rows (about size bytes) if texts are long, so that what a kernel makes on the way stays small beside the batch itself."""
    rows = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


Kernel = Callable[[pa.Array], list[pa.Array]]


def add_columns(df: DataFrame, text_col: str, fields: list[T.StructField], kernel: Callable[[], Kernel], keep: list[str] | None = None) -> DataFrame:
    """df's columns in keep (default: all) and the kernel's, in one Arrow pass without a shuffle.

    kernel() runs once a task and returns a function from the texts of a batch (never null: null counts as empty)
    to one array for each field. A kept column that has the name of a new one gives way to it.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    shown = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    names, n = [f.name for f in schema], len(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *work(part.column(n))], names=names)

    return shown.mapInArrow(run, schema)


def if_small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """df of a few plain columns, marked for broadcast if it has so many rows at most (some 40 MB); else for Spark to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows of each label, without null: one small count, combined on the map side."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] is not None}


def class_sample(df: DataFrame, label: str, key: str, per_class: int, salt: int, counts: dict | None = None) -> DataFrame:
    """About per_class rows of each label, chosen by a hash of the key; every row of a smaller class.

    Rows that share a key go in or out together. Where that leaves a class without rows, or with over twice as many as
    asked for, its rows are drawn by their place in the files as well; if there is still none, some per_class rows are taken.
    """
    counts = class_counts(df, label) if counts is None else counts
    every = sorted(counts.items(), key=lambda kv: str(kv[0]))

    def drawn(unit: Column, classes: list) -> Column:
        keep = F.lit(False)
        for value, count in classes:
            keep = keep | ((F.col(label) == F.lit(value)) & (unit < F.lit(min(1.0, per_class / count))))
        return keep

    unit = lambda *more: F.pmod(F.xxhash64(F.col(key), F.lit(salt), *more), F.lit(1 << 30)).cast("double") / float(1 << 30)
    got = class_counts(df.filter(drawn(unit(), every)), label)
    well = [(v, n) for v, n in every if 0 < got.get(v, 0) <= 2 * per_class + 100]
    out, rest = df.filter(drawn(unit(), well)), [(v, n) for v, n in every if (v, n) not in well]
    if rest:
        placed = df.withColumn("__place", F.monotonically_increasing_id()).filter(drawn(unit(F.col("__place")), rest)).drop("__place")
        out = out.unionAll(placed)
        found = class_counts(placed, label)
        for value, _ in rest:
            if not found.get(value):
                out = out.unionAll(df.filter(F.col(label) == F.lit(value)).limit(per_class))
    return out


def summed(df: DataFrame, size: int, kernel: Callable[[], Callable[[pa.RecordBatch, np.ndarray], None]]) -> np.ndarray:
    """The sum over all rows of a fixed-size count vector that kernel()'s function adds a batch of df to.

    Each task makes one vector, sent as blocks. Blocks meet in three rounds, 64 at a time in the first two, so a group holds
    at most 64 blocks up to a quarter of a million tasks, and the driver gets one vector.
    """
    fan, blocks = 64, 64
    step = -(-size // blocks)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        add, total, seen = kernel(), np.zeros(step * blocks, np.int64), False
        for batch in batches:
            for part in parts(batch):
                add(part, total[:size])
            seen = True
        if seen:
            salt, every = TaskContext.get().partitionId() // fan, total.reshape(blocks, step)
            for k in range(0, blocks, 8):  # a few at a time, so that nothing holds the vector twice
                yield pa.RecordBatch.from_arrays([pa.array(range(k, k + 8), pa.int32()), pa.array([salt] * 8, pa.int32()), pa.array([x.tobytes() for x in every[k : k + 8]], pa.binary())], names=["block", "salt", "data"])

    def add_up(group: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for x in group.column("data"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "salt": pa.array([group.column("salt")[0].as_py() // fan], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, salt int, data binary"
    out = df.mapInArrow(count, schema)
    for keys in (["block", "salt"], ["block", "salt"], ["block"]):
        out = out.groupBy(*keys).applyInArrow(add_up, schema)
    total = np.zeros(step * blocks, np.int64)
    for row in out.collect():
        total[row.block * step : (row.block + 1) * step] = np.frombuffer(bytes(row.data), np.int64)
    return total[:size]


def with_notes(rows: DataFrame, notes: DataFrame, part: str, parts: int, work: Callable[[Iterable[pa.RecordBatch], list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType, order: list[str] | None = None) -> DataFrame:
    """work(batches of a partition's rows, batches of the notes to it) for each partition of rows by the number in the column part.

    Rows and notes of a partition meet in one task, dealt by its number itself, so tasks are as even as the partitions were. The
    notes come first and are held; rows stream, in the order of the columns in order. The columns of notes must have names of their own.
    """
    kept, told = [c for c in rows.columns if c != part], [c for c in notes.columns if c != part]
    nothing = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    both = notes.select(F.col(part), F.lit(0).alias("__kind"), *nothing(rows, kept), *told).unionAll(rows.select(F.col(part), F.lit(1).alias("__kind"), *kept, *nothing(notes, told)))
    dealt = both.repartitionById(max(1, parts), F.col(part)).sortWithinPartitions("__kind", *(order or []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def own() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = int(np.count_nonzero(batch.column(1).to_numpy() == 0))
                if n:
                    held.append(batch.slice(0, n).select(told))
                if n < batch.num_rows:
                    yield batch.slice(n).select(kept)

        stream = own()
        first = next(stream, None)  # by then all notes are in
        if first is not None:
            yield from work((b for bs in ([first], stream) for b in bs), held)

    return dealt.mapInArrow(run, schema)
