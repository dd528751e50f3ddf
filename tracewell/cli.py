"""Command line: python -m tracewell.cli ROOT [options]."""

from __future__ import annotations

import argparse
import os
import sys
import time

from tracewell.operators import sinks, triage
from tracewell.plans import analysis
from tracewell.session import local_session, share_code
from tracewell.sources import baselines, ignore, projects
from tracewell.taint import flows

FORMATS = ("summary", "detailed", "compact", "grouped", "json", "sarif", "csv", "html")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell")
    p.add_argument("root")
    p.add_argument("--format", choices=FORMATS)
    p.add_argument("--output")
    p.add_argument("--group-by", choices=("severity", "file_path", "engine"), default="severity")
    p.add_argument("--confidence-threshold", choices=("high", "medium", "low"))
    p.add_argument("--include-tests", action="store_true")
    p.add_argument("--min-risk", type=int)
    p.add_argument("--min-priority", choices=("low", "medium", "high", "critical"))
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--baseline", help="save the findings as known and stop")
    p.add_argument("--compare-baseline", help="report only findings that are not known")
    p.add_argument("--flows", action="store_true", help="report flows from requests to sinks instead of findings")
    p.add_argument("--include-sanitized", action="store_true")
    p.add_argument("--fail-on", choices=("error", "warn", "none"))
    return p


def format_of(given: str | None, output: str | None) -> str:
    """The format asked for, else the output's ending, else compact lines on a build machine and a summary elsewhere."""
    ending = os.path.splitext(output or "")[1].lstrip(".")
    return given or (ending if ending in ("html", "json", "sarif", "csv") else "compact" if os.environ.get("CI") else "summary")


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or local_session("*")
    share_code(spark)
    root = os.path.abspath(args.root)
    found = projects.upward(root, projects.CONFIG_NAMES)
    if found:
        with open(found, encoding="utf-8") as f:
            config = projects.Config.merged(f.read())
    else:
        config = projects.Config.merged(None)
    config.confidence_threshold = args.confidence_threshold or config.confidence_threshold
    config.exclude_tests = config.exclude_tests and not args.include_tests
    ignored = projects.upward(root, (".gitignore",)) if config.respect_ignore else None
    rules = ignore.load(spark, ignored) if ignored else None

    if args.flows:
        found_flows = analysis.flows_of(spark, root, config, rules, args.include_sanitized)
        if (args.output or "").endswith(".sarif"):
            flows.write_sarif(found_flows, args.output)
        else:
            out = open(args.output, "w", encoding="utf-8") if args.output else sys.stdout
            for row in (flows.rendered if args.format == "compact" else flows.reported)(found_flows).toLocalIterator():
                print(row["value"], file=out)
        return int((args.fail_on or config.fail_on) != "none" and found_flows.filter("NOT sanitized").limit(1).count() > 0)

    began = time.time()
    issues = analysis.analyze(spark, root, config, rules)
    if args.baseline:
        analysis.save_baseline(issues, args.baseline)
        return 0
    known = baselines.load(spark, args.compare_baseline) if args.compare_baseline else None
    if args.compare_baseline and known is None:
        print("no baseline found; all findings are reported", file=sys.stderr)
    issues = analysis.selected(issues, args.min_risk, args.min_priority, known)
    issues = (triage.quiet(issues) if args.quiet else issues).cache()

    kind, output = format_of(args.format, args.output), args.output
    if kind == "json":
        total = projects.source_files(spark, root).count()
        sinks.write_json(issues, output or "findings.json", total, projects.scanned(projects.source_files(spark, root), config, rules).count(), config.fail_on, config.rules, int(1000 * (time.time() - began)))
    elif kind == "sarif":
        sinks.write_sarif(issues, output or "findings.sarif", root)
    elif kind == "csv":
        sinks.write_csv(issues, output or "findings-csv")
    elif kind == "html":
        sinks.write_html(issues, output or "findings.html")
    else:
        shown = {"summary": sinks.summary_text, "grouped": lambda x: sinks.grouped_text(x, args.group_by)}.get(kind)
        lines = [shown(issues)] if shown else (r["value"] for r in {"compact": sinks.compact_rows, "detailed": sinks.detailed_rows}[kind](issues).toLocalIterator())
        out = open(output, "w", encoding="utf-8") if output else sys.stdout
        for line in lines:
            print(line, file=out)
    return sinks.exit_status(issues, args.fail_on or config.fail_on)


if __name__ == "__main__":
    try:
        sys.exit(main())
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        sys.exit(2)
