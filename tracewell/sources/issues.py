"""Adapters: tables that stand for issues, files and graphs in queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import triage

ENGINES = {"error": "stack-trace-exposure", "click": "missing-await", "view": "console-in-production", "signup": "missing-input-validation", "purchase": "idor"}
FOLDERS = ("src/api", "src/auth", "src/scripts", "src/tests", "dist", "src/admin", "src/config", "src/services")
TOPICS = ("trackEvent", "saveOrder", "sendMail", "validation of id", "read of catalog", "empty catch", "plain call")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(number, values: tuple[str, ...]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def from_events(events: DataFrame) -> DataFrame:
    """Every event as one issue."""
    engine = F.lit(None).cast("string")
    for kind, name in ENGINES.items():
        engine = F.when(F.col("event_type") == kind, name).otherwise(engine)
    k = F.get_json_object("props", "$.k").cast("int")
    issues = events.select(
        F.col("event_id").alias("ord"), engine.alias("engine"),
        F.when(F.col("value") >= 120, "error").when(F.col("value") >= 40, "warning").otherwise("info").alias("severity"),
        F.when(k >= 60, "high").when(k >= 30, "medium").when(k >= 10, "low").alias("confidence"),
        F.concat(F.lit("/srv/app/"), pick(F.col("user_id"), FOLDERS), F.lit("/u"), F.col("user_id").cast("string"), F.lit(".ts")).alias("file_path"),
        (F.col("event_id") % 400 + 1).cast("int").alias("line"),
        F.concat(F.lit("Check "), F.col("event_type"), F.lit(": "), pick(F.col("event_id"), TOPICS)).alias("message"),
        (k / F.lit(16.0)).alias("entropy"),
        F.concat(F.lit("  "), F.col("event_type"), F.lit("   ("), (F.col("event_id") % 5).cast("string"), F.lit(") ")).alias("context_snippet"),
    )
    return triage.located(issues)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, edge_ix, callee): two calls from each supplier, in a graph with cycles."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = suppliers.count()
    s = F.col("s_suppkey")
    return suppliers.select(s.alias("caller"), F.explode(F.array(F.struct(F.lit(0).alias("edge_ix"), ((7 * s + 3) % n + 1).alias("callee")), F.struct(F.lit(1).alias("edge_ix"), ((5 * s) % n + 1).alias("callee")))).alias("e")).select("caller", "e.edge_ix", "e.callee")
