"""Headline queries: one warm-up, then the median of three runs into a noop sink.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the headline list). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pipelab.plans.queries import QUERIES  # noqa: E402
from pipelab.session import build_session  # noqa: E402

HEADLINE = [
    "e16_metrics_report", "e16_metrics_report_multiclass", "e13_feature_error_correlation", "e15_regression_error_stats",
    "d1_stratified_split", "d3_stratified_kfold", "f1_impute_median", "f5_scale_standard", "f16_preprocess",
    "a2_upsert", "a4_replay_archive", "a5_history", "a7_top_n", "a9_diverse_n", "a12_lineage", "a13_best_so_far",
    "t1_extract_json", "t5_validate_code", "t9_choose_code", "m1_fit_logistic",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run_once(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(3)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
