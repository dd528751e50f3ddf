"""Triage of the issue table: filters, severity, risk and priority, all as Column expressions without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import paths, scalars

# Substrings that decide results.
FIRE_AND_FORGET = ("log", "track", "send", "publish", "emit", "queue", "schedule", "cache")
DEV_UTILITY = ("/cli.", "/bin/", "/scripts/", "/tools/", "logger.ts", "log.ts", "/dev/", "/debug/")
QUIET_ROUTE = ("/internal/", "/admin/", "/health", "/metrics", "/status")


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def auto_ignored(issues: DataFrame) -> Column:
    """Whether an issue is one of the four kinds that are not worth a report."""
    path, message, engine = F.lower("file_path"), F.lower("message"), issues["engine"]
    forgotten = (engine == "missing-await") & contains_any(message, FIRE_AND_FORGET)
    utility = (engine == "console-in-production") & contains_any(path, DEV_UTILITY)
    optional = contains_any(path, ("package-resolver", "config")) & contains_any(message, ("silently swallows", "empty catch"))
    catch = (engine == "empty-catch") & (contains_any(path, ("/migration", "/seed", "/init", "/setup")) | optional)
    access = ((engine == "idor") | message.contains("validation")) & (contains_any(path, QUIET_ROUTE) | F.coalesce(F.col("confidence") == "low", F.lit(False)))
    return forgotten | utility | catch | access


def at_least_confidence(issues: DataFrame, least: str) -> DataFrame:
    return issues.filter(scalars.lookup(scalars.confidence(F.col("confidence")), scalars.CONFIDENCE, 0) >= scalars.CONFIDENCE[least])


def boosted(issues: DataFrame) -> DataFrame:
    path = F.lower("file_path")
    sure = ((F.col("engine") == "hardcoded-secret") & (F.col("entropy") > 4.5)) | ((F.col("engine") == "stack-trace-exposure") & contains_any(path, ("/api/", "/route", "/handler")))
    return issues.withColumn("confidence", F.when(F.coalesce(sure, F.lit(False)), F.lit("high")).otherwise(F.col("confidence")))


def adjusted(issues: DataFrame) -> DataFrame:
    """Severity by context, step by step; rows of generated files go."""
    path, engine, test, was = F.lower("file_path"), F.col("engine"), F.col("is_test"), F.col("severity")
    lowered = F.when((was == "error") & (F.col("confidence") == "low"), "warning").otherwise(was)
    down = F.when(lowered == "error", "warning").when(lowered == "warning", "info").otherwise(lowered)
    stepped = F.when(test & (engine != "hardcoded-secret"), down).otherwise(lowered)
    console = F.when(contains_any(path, ("/dev/", "/debug/", "/scripts/", "/tools/")) | test, "info").otherwise(stepped)
    last = F.when(engine == "console-in-production", console).when(engine.isin("empty-catch", "missing-await") & test & (stepped == "error"), "warning").otherwise(stepped)
    return issues.filter(~F.col("is_generated")).withColumn("severity", last)


def scored(issues: DataFrame) -> DataFrame:
    """risk_score 0 to 100 and its priority."""
    path, engine = F.lower("file_path"), F.col("engine")
    one = F.lit(1.0)
    score = F.when(F.col("severity") == "error", 40.0).when(F.col("severity") == "warning", 20.0).otherwise(5.0)
    conf = scalars.confidence(F.col("confidence"))
    score = score * F.when(conf == "high", 2.0).when(conf == "medium", 1.2).otherwise(0.8)
    score = score * F.when(F.col("is_test") & (engine != "hardcoded-secret"), 0.3).otherwise(one)
    score = F.when(F.col("is_generated"), 0.0).otherwise(score)
    score = score * F.when(engine.isin(*scalars.SECURITY), 1.5).otherwise(one)
    score = score * F.when(contains_any(path, ("/config/", "/auth/", "/security/", "credentials")) | path.endswith(".env"), 1.3).otherwise(one)
    score = score * F.when(contains_any(path, ("/dev/", "/debug/", "/scripts/")), 0.7).otherwise(one)
    risk = F.least(scalars.half_up(score), F.lit(100))
    return issues.withColumn("risk_score", risk).withColumn("priority", F.when(F.col("risk_score") >= 80, "critical").when(F.col("risk_score") >= 50, "high").when(F.col("risk_score") >= 20, "medium").otherwise("low"))


def triaged(issues: DataFrame, least_confidence: str = "low") -> DataFrame:
    """The whole chain in its order: ignore, threshold, boost, adjust, score. The threshold comes before the boost."""
    kept = at_least_confidence(issues.filter(~auto_ignored(issues)), least_confidence)
    return scored(adjusted(boosted(kept)))


def quiet(issues: DataFrame) -> DataFrame:
    return issues.filter((F.col("severity") == "error") | ((F.col("severity") == "warning") & (scalars.confidence(F.col("confidence")) == "high")))


def located(issues: DataFrame) -> DataFrame:
    """Adds is_test and is_generated from the path."""
    return issues.withColumn("is_test", paths.is_test(F.col("file_path"))).withColumn("is_generated", paths.is_generated(F.col("file_path")))
