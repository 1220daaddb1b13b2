"""Time registered queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a
comma-separated choice (``all`` for every query). Each query runs once to warm up
and then ``BENCH_RUNS`` times; the median counts. The value is the sum of medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyloom import plans  # noqa: E402
from tallyloom.session import drop_scratch, local_session  # noqa: E402

HEADLINE = [
    "error_rate", "counter_increase", "counter_rate", "rate_5m", "range_query", "sum_by", "topk_per_step",
    "instant_lookup", "avg_series", "vector_ratio", "histogram_quantile", "histogram_mean", "panel_union",
    "latency_profile", "latency_profile_hourly", "success_rate", "label_cardinality", "dataset_profile",
    "daily_rollup", "daily_runs", "fact_dim_topn", "preagg_join", "missing_from", "target_status",
    "write_events", "partition_overwrite", "upsert_latest", "backfill_days", "ingest_jsonl",
    "stream_windowed_counts", "stream_dedup", "stream_dead_letters", "latest_by_key", "consumer_lag",
    "order_check", "knn_cosine", "ridge_mse", "run_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    plans.load_all()
    names = list(plans.QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus)
    timings = {}
    for name in names:
        taken = []
        for run in range(runs + 1):
            started = time.perf_counter()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - started)
            drop_scratch(spark)
        timings[name] = round(statistics.median(taken), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": f"sum of warm medians over {len(names)} queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
