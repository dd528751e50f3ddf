"""Report sinks. Rows are rendered by Spark and, where the format is one document, streamed to it partition by partition."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import scalars
from tracewell.operators import report

SARIF = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def _optional(issues: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in issues.columns else F.lit(None).cast(kind)


def json_rows(issues: DataFrame) -> DataFrame:
    """(value) one JSON object for each issue."""
    fields = F.struct("engine", "severity", "message", F.col("file_path").alias("filePath"), F.struct("line", F.coalesce(_optional(issues, "column", "int"), F.lit(1)).alias("column")).alias("location"), _optional(issues, "suggestion").alias("suggestion"), F.col("engine").alias("ruleId"))
    return issues.orderBy("ord").select(F.to_json(fields).alias("value"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "info", "note").otherwise(severity)


def sarif_rows(issues: DataFrame, root: str = "") -> DataFrame:
    """(value) one result object for each issue; paths are relative to root with forward slashes."""
    uri = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    uri = F.when(uri.startswith(root.rstrip("/") + "/"), F.expr(f"substr(replace(file_path, '\\\\', '/'), {len(root.rstrip('/')) + 2})")).otherwise(uri) if root else uri
    place = F.struct(F.struct(F.struct(uri.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.coalesce(_optional(issues, "column", "int"), F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"))
    suggestion = _optional(issues, "suggestion")
    fixes = F.when(suggestion.isNotNull(), F.array(F.struct(F.struct(suggestion.alias("text")).alias("description"))))
    result = F.struct(F.col("engine").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), fixes.alias("fixes"))
    return issues.orderBy("ord").select(F.to_json(result).alias("value"))


def sarif_rules(issues: DataFrame) -> list[dict]:
    """One rule for each engine, with the level of its first issue, in order of appearance."""
    first = issues.groupBy("engine").agg(F.min("ord").alias("ord"), F.min_by(sarif_level(F.col("severity")), "ord").alias("level")).orderBy("ord").collect()
    title = lambda e: e.replace("-", " ").title()
    return [{"id": r["engine"], "name": title(r["engine"]).replace(" ", ""), "shortDescription": {"text": title(r["engine"])}, "defaultConfiguration": {"level": r["level"]}} for r in first]


def _stream(rows: DataFrame) -> Iterator[str]:
    """Rows in order, one partition at a time on the driver."""
    return (r["value"] for r in rows.toLocalIterator(prefetchPartitions=True))


def _document(path: str, head: str, rows: Iterator[str], tail: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.write(head)
        for k, row in enumerate(rows):
            out.write((",\n" if k else "\n") + row)
        out.write("\n" + tail)


def write_json(issues: DataFrame, path: str, total_files: int, analyzed_files: int, fail_on: str = "error", rules: dict[str, str] | None = None, milliseconds: int = 0) -> None:
    counts = report.final_counts(issues).first()
    summary = {"totalFiles": total_files, "analyzedFiles": analyzed_files, "totalIssues": counts["total"], "criticalIssues": counts["error_count"], "warnings": counts["warning_count"], "timestamp": datetime.now(timezone.utc).isoformat(), "duration": milliseconds}
    config = {"failOn": fail_on, "rulesEnabled": [r for r, level in (rules or {}).items() if level != "off"]}
    _document(path, f'{{"summary": {json.dumps(summary)}, "issues": [', _stream(json_rows(issues)), f'], "config": {json.dumps(config)}}}')


def write_sarif(issues: DataFrame, path: str, root: str = "", version: str = "0.1.0") -> None:
    driver = {"name": "tracewell", "version": version, "rules": sarif_rules(issues)}
    _document(path, f'{{"version": "2.1.0", "$schema": {json.dumps(SARIF)}, "runs": [{{"tool": {{"driver": {json.dumps(driver)}}}, "results": [', _stream(sarif_rows(issues, root)), "]}]}")


CSV = ("Severity", "Confidence", "File", "Line", "Engine", "Message", "Suggestion")


def write_csv(issues: DataFrame, path: str) -> None:
    """Seven columns, all quoted, as a folder of CSV files."""
    columns = (F.col("severity"), scalars.confidence(F.col("confidence")), F.col("file_path"), F.col("line"), F.col("engine"), F.col("message"), _optional(issues, "suggestion"))
    shown = issues.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(columns, CSV, strict=True)])
    shown.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def compact_rows(issues: DataFrame) -> DataFrame:
    """(value) file:line:column [engine] severity: message, by display score; info shows as warning."""
    score = scalars.display_risk(F.col("severity"), F.col("confidence"), F.col("engine"))
    severity = F.when(F.col("severity") == "error", "error").otherwise("warning")
    line = F.concat(F.col("file_path"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.coalesce(_optional(issues, "column", "int"), F.lit(1)).cast("string"), F.lit(" ["), F.col("engine"), F.lit("] "), severity, F.lit(": "), F.col("message"))
    return issues.orderBy(score.desc(), "ord").select(line.alias("value"))


def detailed_rows(issues: DataFrame) -> DataFrame:
    """(value) errors and then warnings; info rows are left out."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1)
    return issues.withColumn("__rank", rank).filter("__rank IS NOT NULL").orderBy("__rank", "ord").select(F.concat_ws("\n  ", F.concat(F.upper("severity"), F.lit(" "), F.col("file_path"), F.lit(":"), F.col("line").cast("string")), "message", _optional(issues, "suggestion"), _optional(issues, "context_snippet")).alias("value"))


def grouped_text(issues: DataFrame, key: str, n: int = 10) -> str:
    """At most n rows of each group and how many more it has."""
    out, last = [], object()
    shown = report.top_per_group(issues, key, n).orderBy(key, "rn")
    for r in shown.toLocalIterator():
        if r[key] != last:
            last = r[key]
            out.append(f"\n{last}")
        out.append(f"  {r['severity']} {r['file_path']}:{r['line']} {r['message']}")
        if r["rn"] == n and r["remaining"]:
            out.append(f"  ... and {r['remaining']} more")
    return "\n".join(out).strip()


def summary_text(issues: DataFrame) -> str:
    """Counts, buckets, the diversified top issues and the noisiest engines."""
    counts, buckets = report.final_counts(issues).first(), report.summary_buckets(issues).first()
    out = [f"{counts['total']} issues: {counts['error_count']} errors, {counts['warning_count']} warnings, {counts['info_count']} infos", f"critical {buckets['critical']}, high {buckets['high']}, medium {buckets['medium']}, low {buckets['low']}", "Top issues:"]
    out += [f"  {r['engine']} {r['file_path']}:{r['line']} {r['message']}" for r in report.diversified(issues).collect()]
    out += ["Noisy engines:"] + [f"  {r['engine']} {r['n']} ({r['share']:.0%})" for r in report.high_volume(issues).orderBy(F.col("n").desc()).collect()]
    return "\n".join(out)


def write_html(issues: DataFrame, path: str) -> None:
    """A page with totals, engines, files and all rows, the riskiest first."""
    counts = report.final_counts(issues).first()
    root = report.common_root(issues).first()["root"] or ""
    engines = report.per_engine(issues).orderBy(F.col("criticals").desc(), F.col("warnings").desc(), "engine").collect()
    files = report.top_by_count(issues, "file_path", 5).collect()
    score = scalars.display_risk(F.col("severity"), F.col("confidence"), F.col("engine"))
    rows = issues.orderBy(score.desc(), "ord")
    cell = lambda *values: "<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in values) + "</tr>\n"
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"<!DOCTYPE html><meta charset='utf-8'><title>Findings</title><h1>{counts['total']} findings</h1><p>{counts['error_count']} errors, {counts['warning_count']} warnings, {counts['info_count']} infos below {html.escape(root)}</p>\n")
        out.write("<h2>Engines</h2><table>" + "".join(cell(r["engine"], r["criticals"], r["warnings"], r["files"]) for r in engines) + "</table>\n")
        out.write("<h2>Files</h2><table>" + "".join(cell(r["file_path"][len(root) :].lstrip("/"), r["n"]) for r in files) + "</table>\n<h2>Rows</h2><table>")
        for r in rows.toLocalIterator():
            out.write(cell(r["severity"], r["engine"], f"{r['file_path']}:{r['line']}", r["message"]))
        out.write("</table>\n")


def exit_status(issues: DataFrame, fail_on: str = "error") -> int:
    """1 if an issue is at or above fail_on (error or warning), else 0."""
    levels = {"error": ["error"], "warn": ["error", "warning"], "warning": ["error", "warning"]}.get(fail_on, [])
    return int(bool(levels) and issues.filter(F.col("severity").isin(*levels)).limit(1).count() > 0)
