"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.
Each query's rows are all produced and thrown away (``noop``), best of ``BENCH_RUNS``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sealgrade.catalog import REGISTRY  # noqa: E402
from sealgrade.session import get_session  # noqa: E402

HEADLINE = (
    "a06_class_distribution", "a07_confidence_levels", "a12_kpis", "a13_estimated_accuracy",
    "a24_keyword_patterns", "a25_context_patterns", "a30_daily_accuracy", "c03_running_accuracy",
    "c04_class_terms", "f02_pii_report", "f08_f10_feature_flags", "j04_apply_feedback",
    "k04_potential_errors", "l01_adjusted_confidence", "l02_learned_override",
    "m04_m06_repaired_verdicts", "m13_m14_j07_verification_routing", "preset_basic",
    "preset_enhanced", "a03_cluster_summary", "r05_review_queue", "t01_pages_by_chars",
    "t02_pages_by_words", "s11_silver_segments", "w01_w02_operations",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = get_session(
        master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name}: {best:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, sum of best times", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus), "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
