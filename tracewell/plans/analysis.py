"""The whole chain over a source tree: scan, parse, detect, triage, compare with a baseline."""

from __future__ import annotations

import logging
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.detect import engines
from tracewell.extract import bindings, facts
from tracewell.functions import scalars
from tracewell.operators import graphs, report, triage
from tracewell.sources import baselines, projects, rules
from tracewell.taint import flows, frameworks, resolve, summaries


def issues_of(detected: DataFrame) -> DataFrame:
    """Detected rows as the issue table; ord follows file, engine and place."""
    ordered = detected.orderBy("path", "engine_rank", "line", "column", "message").withColumn("ord", F.monotonically_increasing_id())
    return ordered.select("ord", "engine", "severity", "confidence", F.col("path").alias("file_path"), "line", "column", "message", "suggestion", F.lit(None).cast("double").alias("entropy"), "context_snippet", "is_test", "is_generated")


def analyze(spark: SparkSession, root: str, config: projects.Config | None = None, ignore_rules: list[tuple[str, bool]] | None = None) -> DataFrame:
    """Triaged issues of a source tree. Facts are cut, as each engine reads them: files are parsed once."""
    config = config or projects.Config()
    files = projects.scanned(projects.source_files(spark, root), config, ignore_rules)
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{package.json,bun.lock,package-lock.json,yarn.lock,pnpm-lock.yaml}").load(root)
    manifests = texts.select(F.regexp_replace("path", "^file:", "").alias("path"), F.decode("content", "UTF-8").alias("content")).filter(~F.col("path").contains("/node_modules/"))
    read = graphs.cut(facts.extract(files))
    tops = spark.read.format("binaryFile").option("pathGlobFilter", "tsconfig*.json").load(root).select("path", F.decode("content", "UTF-8").alias("content")).collect()  # of the top folder: a few
    prefixes = tuple(sorted(projects.aliases({posixpath.basename(r["path"]): r["content"] for r in tops})))
    modules = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "package.json").load(root).select(F.regexp_replace("path", "^file:", "").alias("path"))
    known = projects.importable(engines.checked_imports(read, prefixes), manifests, projects.installed(modules))
    failed: list[tuple[str, str]] = []
    detected = engines.created(engines.detect(read, known, config.rules, prefixes, failed, files), files)
    for name, why in failed:
        logging.getLogger("tracewell").warning("engine %s left out: %s", name, why)
    found = graphs.cut(issues_of(detected))
    return triage.triaged(found, config.confidence_threshold).orderBy(F.coalesce("risk_score", F.lit(0)).desc(), "ord")


def selected(issues: DataFrame, min_risk: int | None = None, min_priority: str | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Issues at or above a risk and a priority that a baseline has not."""
    if min_risk is not None:
        if not 0 <= min_risk <= 100:
            raise ValueError("min_risk must be 0 to 100")
        issues = issues.filter(F.coalesce("risk_score", F.lit(0)) >= min_risk)
    if min_priority is not None:
        issues = issues.filter(scalars.lookup(F.coalesce("priority", F.lit("low")), scalars.PRIORITY, 0) >= scalars.PRIORITY[min_priority])
    if baseline is not None:
        issues = report.new_against(fingerprinted(issues), baseline)
    return issues


def fingerprinted(issues: DataFrame) -> DataFrame:
    return issues.withColumn("fingerprint", scalars.baseline_key(F.col("file_path"), F.col("line"), F.col("engine"), F.col("message")))


def save_baseline(issues: DataFrame, path: str) -> None:
    baselines.save(fingerprinted(issues), path)


def flows_of(spark: SparkSession, root: str, config: projects.Config | None = None, ignore_rules: list[tuple[str, bool]] | None = None, include_sanitized: bool = False, depth: int = 10) -> DataFrame:
    """Flows from requests to sinks over a source tree: parsed, resolved, summarised and searched; the project's own rule files
    and the handlers of its frameworks count."""
    files = graphs.cut(projects.scanned(projects.source_files(spark, root), config or projects.Config(), ignore_rules))
    read, bound = graphs.cut(facts.extract(files)), graphs.cut(bindings.extract(files))
    own = rules.load(spark, root)
    for file, why in own.errors:
        logging.getLogger("tracewell").warning("rule file %s: %s", file, why)
    named = graphs.cut(frameworks.normalized(bound, frameworks.routes(bound, read)))
    return flows.forward(summaries.build(named, resolve.links(named, read, files), own.catalogue()), include_sanitized=include_sanitized, depth=depth)
