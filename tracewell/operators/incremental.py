"""Change detection against a snapshot of content hashes, in batch and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(path).alias("path"), F.substring(F.sha2(F.coalesce(F.col(content), F.lit("")), 256), 1, 16).alias("content_hash"))


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, state) of two snapshots: cached where the hash is the same, stale where it is new or differs, deleted where it is gone."""
    old = before.select("path", F.col("content_hash").alias("old_hash"))
    state = F.when(F.col("content_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("content_hash"), "cached").otherwise("stale")
    return now.join(old, "path", "full_outer").select("path", state.alias("state"))


def counts(compared_rows: DataFrame) -> DataFrame:
    """(valid, stale, missing): entries of the old snapshot that still hold, that changed, and whose file is gone."""
    return compared_rows.agg(F.count_if(F.col("state") == "cached").alias("valid"), F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "deleted").alias("missing"))
