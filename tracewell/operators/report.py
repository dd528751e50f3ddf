"""Aggregates, rankings and orderings of the issue table. Ties keep the order of `ord`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import scalars, words


def by_key(issues: DataFrame, key: str) -> DataFrame:
    """Counts by severity, in the report's order: severities by rank, other keys by errors and then by all."""
    counts = issues.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
    )
    if key == "severity":
        return counts.orderBy(scalars.lookup(F.col("severity"), {"error": 0, "warning": 1, "info": 2}, 3))
    return counts.orderBy(F.col("errors").desc(), F.col("total").desc(), key)


def per_engine(issues: DataFrame) -> DataFrame:
    return issues.groupBy("engine").agg(
        F.count_if(F.col("severity") == "error").alias("criticals"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.countDistinct("file_path").alias("files"),
    )


def summary_buckets(issues: DataFrame) -> DataFrame:
    conf, severity = scalars.confidence(F.col("confidence")), F.col("severity")
    return issues.agg(
        F.count_if((severity == "error") & (conf == "high")).alias("critical"),
        F.count_if((severity == "warning") & (conf == "high")).alias("high"),
        F.count_if((severity == "warning") & (conf == "medium")).alias("medium"),
        F.count_if(conf == "low").alias("low"),
    )


def final_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("error", "warning", "info")], F.lit(0).cast("long").alias("low_count"), F.count("*").alias("total"))


def top_by_count(issues: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys; on ties the one seen first."""
    return issues.groupBy(key).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).orderBy(F.col("n").desc(), "first_ord").limit(n)


def high_volume(issues: DataFrame, least: int = 30, share: float = 0.4) -> DataFrame:
    """Engines with so many rows or so large a share of all."""
    counts = issues.groupBy("engine").agg(F.count("*").alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # over one row for each engine
    return counts.filter((F.col("n") >= least) | (F.col("share") >= share))


def nth_in(issues: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return issues.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_in(issues: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return nth_in(issues, keys, *order).filter("rn = 1").drop("rn")


def diversified(issues: DataFrame, n: int = 5) -> DataFrame:
    """The n issues shown on top: the best of each engine first, then the best of the rest. At most n of an engine are ranked."""
    score = scalars.display_risk(F.col("severity"), F.col("confidence"), F.col("engine"))
    ranked = nth_in(issues.withColumn("display_score", score), ["engine"], F.col("display_score").desc(), F.col("ord")).filter(F.col("rn") <= n)
    return ranked.orderBy((F.col("rn") > 1), F.col("display_score").desc(), "ord").limit(n)


def top_per_group(issues: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first n rows of each group and how many more it has; the count is a join, so that only n rows a group are kept."""
    first = nth_in(issues, [key], F.col("ord")).filter(F.col("rn") <= n)
    return first.join(issues.groupBy(key).agg(F.count("*").alias("of")), key).withColumn("remaining", F.greatest(F.col("of") - n, F.lit(0))).drop("of")


def by_danger(issues: DataFrame, n: int = 10) -> DataFrame:
    return issues.withColumn("danger", scalars.lookup(F.col("engine"), scalars.DANGER_RANK, 99)).orderBy("danger", "ord").limit(n)


def common_root(issues: DataFrame) -> DataFrame:
    """The longest common directory prefix of all paths, from the least and greatest path alone; its last segment is left off."""
    ends = issues.agg(F.min(F.split("file_path", "/")).alias("a"), F.max(F.split("file_path", "/")).alias("b"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i)))
    return ends.select(F.array_join(F.slice("a", 1, F.greatest(same - 1, F.lit(0))), "/").alias("root"))


def deduplicated(issues: DataFrame, key: Column) -> DataFrame:
    """(fingerprint, primary_ord, occurrences, files): one row for each group of equal findings."""
    return issues.groupBy(key.alias("fingerprint")).agg(F.min("ord").alias("primary_ord"), F.count("*").alias("occurrences"), F.countDistinct("file_path").alias("files"))


def dedup_stats(groups: DataFrame) -> DataFrame:
    total, unique = F.sum("occurrences"), F.count("*")
    return groups.agg(
        F.coalesce(total, F.lit(0)).alias("total"), unique.alias("unique_groups"), F.count_if(F.col("occurrences") > 1).alias("duplicated_groups"),
        F.when(total > 0, F.floor((total - unique) / total * 100 + 0.5)).otherwise(F.lit(0)).cast("int").alias("reduction_percent"),
    )


def new_against(issues: DataFrame, baseline: DataFrame, on: str = "fingerprint") -> DataFrame:
    """Rows whose fingerprint the baseline has not; repeated rows stay."""
    return issues.join(baseline.select(on), on, "left_anti")


def filtered(issues: DataFrame, severities: list[str] | None = None, engines: list[str] | None = None, confidences: list[str] | None = None, file: str | None = None, text: str | None = None) -> DataFrame:
    """Issues as a reader of a report picks them: by lists, by a wildcard over the path (`*` and `?`; plain text fits anywhere),
    and by text in the message, the path or the engine, whatever the case."""
    out = issues
    for column, chosen in (("severity", severities), ("engine", engines)):
        out = out.filter(F.col(column).isin(*chosen)) if chosen else out
    if confidences:
        out = out.filter(scalars.confidence(F.col("confidence")).isin(*confidences))
    if file:
        out = out.filter(words.fits_glob(F.col("file_path"), file if "*" in file or "?" in file else f"*{file}*"))
    if text:
        low = text.lower()
        out = out.filter(F.lower("message").contains(low) | F.lower("file_path").contains(low) | F.lower("engine").contains(low))
    return out


def shares(issues: DataFrame) -> DataFrame:
    """(severity, n, share, files): the share in per cent, rounded half up to one place, of all issues."""
    counts = issues.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))
    total = F.sum("n").over(Window.partitionBy())  # over one row for each severity
    return counts.select("severity", "n", (F.floor(F.col("n") / total * 1000 + 0.5) / 10).alias("share"), "files")


def phases(events: DataFrame, name: str, at: str) -> DataFrame:
    """(phase, started, ended): phases in the order in which they begin, each until the next one; the last is open."""
    begun = events.groupBy(F.col(name).alias("phase")).agg(F.min(at).alias("started"))
    return begun.withColumn("ended", F.lead("started").over(Window.orderBy("started", "phase")))  # over one row for each phase
