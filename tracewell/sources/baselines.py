"""Baselines and snapshots: known fingerprints and content hashes of earlier runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = "1"


def save(issues: DataFrame, path: str, fingerprint: str = "fingerprint") -> None:
    """Writes one JSON row for each issue (repeats stay) and overwrites what was there."""
    issues.select(F.lit(VERSION).alias("version"), F.current_timestamp().alias("saved_at"), F.col(fingerprint).alias("fingerprint")).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """(fingerprint) of a baseline: rows as save() writes them, or one document with a list; None if missing or unreadable."""
    try:
        read = spark.read.schema("version string, fingerprint string, fingerprints array<string>, _corrupt string").option("multiLine", False).option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
        if read.filter("_corrupt IS NOT NULL").limit(1).count():
            text = "\n".join(r["value"] for r in spark.read.text(path).collect())  # one small document
            return spark.createDataFrame([(f,) for f in json.loads(text).get("fingerprints", [])], "fingerprint string")
        return read.select(F.explode(F.coalesce("fingerprints", F.array("fingerprint"))).alias("fingerprint"))
    except (AnalysisException, ValueError, AttributeError):
        return None


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_hash) of an earlier run; empty if there is none or its version differs."""
    schema = "path string, content_hash string, version string"
    try:
        return spark.read.schema(schema).parquet(path).filter(F.col("version") == VERSION).select("path", "content_hash")
    except AnalysisException:
        return spark.createDataFrame([], "path string, content_hash string")


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(path)
