"""Times of the operators on many skewed events: a third of one series, a third in one hour.

``python bench_skewed.py [rows] [name ...]`` writes the events to a scratch folder of its own, runs each
operator once and prints one JSON line. Not a registered query: it measures plans, not results.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators import asof, events as ev, frequent, ranges, sketches
from tallyloom.operators.samples import to_counter
from tallyloom.session import drop_scratch, local_session, scratch_path
from tallyloom.streaming import log as logs


def skewed(spark: SparkSession, rows: int) -> DataFrame:
    """Thirty days of events; row numbers decide who and when, by multiplications that scatter them."""
    path = scratch_path(spark, "skewed")
    scattered = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    series = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), scattered % 2000))
    micros = F.when(F.col("id") % 3 == 1, 1_705_312_800_000_000 + scattered % 3_600_000_000).otherwise(
        1_704_067_200_000_000 + scattered % (30 * 86_400_000_000))
    spark.range(rows).select(
        F.col("id").alias("event_id"), series.alias("series"), F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts"),
        (scattered % 100_000 / 100).alias("value")).write.parquet(path)
    return spark.read.parquet(path)


def stored_counters(spark: SparkSession, events: DataFrame) -> DataFrame:
    path = scratch_path(spark, "counters")
    to_counter(events, {"series": "series"}).write.parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 20_000_000
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    events = skewed(spark, rows)
    samples = stored_counters(spark, events)
    asked = events.filter("event_id % 20 = 1").select("series", F.col("ts").alias("at"), "event_id")
    facts = events.select("series", "ts", "value")
    jobs = {
        "rate_5m_1m": lambda: ranges.rate(samples, ["series"], "5m", "1m", unique=True),
        "increase_6h_30s": lambda: ranges.increase(samples.filter("series = 'hot'"), ["series"], "6h", "30s", unique=True),
        "counter_rate_1h_15m": lambda: ranges.rate(
            to_counter(events, {"series": "series"}, minute="minute"), ["series"], "1h", "15m", unique=True, minute="minute"),
        "instant_1m": lambda: ranges.instant(facts, ["series"], "1m"),
        "asof_join": lambda: asof.asof_join(asked, facts, ["series"], "at", "ts"),
        "latency_profile": lambda: ev.latency_profile(events, ["series"], "value"),
        "sketch_states": lambda: sketches.quantile_states(events, ["series"], "value"),
        "heavy_keys": lambda: frequent.heavy_keys(events.withColumnRenamed("series", "key"), 0.01),
        "key_skew": lambda: logs.key_skew(events.withColumnRenamed("series", "key")),
    }
    wanted = sys.argv[2:] or list(jobs)
    seconds = {}
    for name in wanted:
        started = time.time()
        jobs[name]().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 1)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"rows": rows, "unit": "sec", "queries": seconds}))
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
