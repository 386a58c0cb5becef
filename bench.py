"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query runs once to
warm up and then three times, of which the median counts; results go to the no-op sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from berthline.plans.catalog import QUERIES
from berthline.session import local_session

HEADLINE = [
    "rank_best", "rank_topk", "feasible_counts", "busy_asof", "used_asof", "place_snapshot", "utilization_timeline",
    "machine_ledger", "intake_clean", "run_kpis", "sla_box_stats", "evaluate_report", "threshold_sweep",
    "fit_temperature", "stratified_split", "score_external",
]

RUNS = 3


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "bench")
    times = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        times[name] = round(median(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps(
        {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}
    ))


if __name__ == "__main__":
    main()
