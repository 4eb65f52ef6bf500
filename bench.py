"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is planned and run into the noop sink once to warm up and BENCH_RUNS times (default
2) for the reported median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tallyforge.plans.registry import QUERIES, load_all
from tallyforge.session import local_session

HEADLINE = [
    "error_groups", "error_anomalies", "log_frequency", "trace_summary", "flaky_tests",
    "todo_items", "classified_debt", "todo_rollup", "bug_findings", "finding_rollup", "secret_findings",
    "feature_flags", "permission_audit", "hardcoded_page_strings", "language_stats", "manifest_dependencies",
    "vulnerable_dependencies", "license_conflicts", "sbom_cyclonedx", "bundle_changes", "sprint_report", "bus_factor",
    "changelog", "change_risk", "bench_regression", "bench_history", "memory_candidates", "upserted_memories",
    "knowledge_top", "similar_decisions", "pattern_profile", "style_violations", "quality_regressions", "merged_coverage",
    "schema_diff", "api_diff", "missing_translations", "dead_files", "env_drift",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    load_all()
    spark = local_session(cpus, "tallyforge-bench")
    spark.sparkContext.setLogLevel("OFF")
    names = [n for n in HEADLINE if n in QUERIES]
    times: dict[str, float] = {}
    for name in names:
        took = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
