"""Runs the headline queries once warm and prints one JSON line with their seconds."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewell.plans import catalog  # noqa: E402
from tracewell.session import local_session  # noqa: E402

HEADLINE = (
    "q01_triage_summary", "q04_severity_adjust", "q05_risk_priority", "q09_group_by_file", "q14_engine_rollup_distinct_files", "q18_diversified_top5",
    "q20_one_per_line", "q25_nesting_level", "q27_dedup_exact", "q30_baseline_new", "q32_path_categories", "q36_suppression", "q38_typosquat_nearest",
    "q40_import_resolution", "q41_reverse_closure", "q43_summary_fixpoint", "q44_forward_flows", "q49_stale_cached_deleted", "q50_progress_window",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    queries, seconds = catalog.queries(), {}
    for name in HEADLINE:
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles code
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
