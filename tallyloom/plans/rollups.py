"""Rollups whose states are merged: quantile and distinct sketches kept per hour and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import sketches
from ..session import scratch_path
from ..sources import tables
from . import query
from .inputs import table

_RANGES = {"whole": (None, None), "days": ("2024-01-10 00:00:00", "2024-01-20 06:00:00")}


def _stored(states: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    tables.overwrite_partitions(states, path, "day")
    return spark.read.parquet(path)


@query("""SELECT 'whole' AS range, event_type, count(*) AS events, true AS p50_in_bounds, true AS p95_in_bounds FROM events GROUP BY ALL
UNION ALL SELECT 'days', event_type, count(*), true, true FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20 06:00:00' GROUP BY ALL""")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of two ranges from hourly sketches; their true ranks are within half a percent."""
    events = table(spark, sf_dir, "events")
    states = _stored(sketches.quantile_states(events, ["event_type", "user_id"], "value"), spark, "quantile-states")
    answers = None
    for name, (since, until) in _RANGES.items():
        found = sketches.quantiles(states, ["event_type"], [0.5, 0.95], since, until)
        rows = events if since is None else events.filter(
            (F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))

        def in_bounds(i: int, q: float):
            guess = F.col("quantiles")[i]
            below, upto = F.avg((F.col("value") < guess).cast("double")), F.avg((F.col("value") <= guess).cast("double"))
            return ((below <= q + 0.005) & (upto >= q - 0.005)).alias(f"p{round(100 * q)}_in_bounds")

        checked = rows.join(found, "event_type").groupBy("event_type", "events").agg(in_bounds(0, 0.5), in_bounds(1, 0.95))
        answer = checked.select(F.lit(name).alias("range"), "event_type", "events", "p50_in_bounds", "p95_in_bounds")
        answers = answer if answers is None else answers.unionByName(answer)
    return answers


@query("""WITH pairs AS (SELECT 'event_type' AS label, event_type AS v, CAST(ts AS DATE) AS day FROM events
UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), CAST(ts AS DATE) FROM events)
SELECT label, count(DISTINCT v) > 50 AS unbounded, true AS in_bounds FROM pairs
WHERE day >= DATE '2024-01-08' AND day < DATE '2024-01-15' GROUP BY 1""")
def cardinality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct label values of a week from daily sketches, within five percent of the exact number."""
    events = table(spark, sf_dir, "events").withColumn("user", F.col("user_id").cast("string"))
    states = _stored(sketches.label_states(events, ["event_type", "user"]), spark, "label-states")
    found = sketches.cardinality(states, "2024-01-08", "2024-01-15", limit=50)
    week = events.filter((F.to_date("ts") >= F.lit("2024-01-08").cast("date")) & (F.to_date("ts") < F.lit("2024-01-15").cast("date")))
    exact = week.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("v")) for n in ("event_type", "user")])).alias("p")
                        ).select("p.*").groupBy("label").agg(F.countDistinct("v").alias("n"))
    return found.join(exact, "label").select(
        "label", "unbounded", (F.abs(F.col("distinct_values") - F.col("n")) <= 0.05 * F.col("n")).alias("in_bounds"))


@query("""WITH pairs AS (SELECT 'event_type' AS label, event_type AS v, CAST(ts AS DATE) AS day FROM events
UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), CAST(ts AS DATE) FROM events),
firsts AS (SELECT label, v, min(day) AS first_day FROM pairs GROUP BY 1, 2),
fresh AS (SELECT label, first_day AS day, count(*) AS n FROM firsts GROUP BY 1, 2),
days AS (SELECT label, day, count(DISTINCT v) AS distinct_values FROM pairs GROUP BY 1, 2)
SELECT d.label, d.day, d.distinct_values, coalesce(f.n, 0) AS new_values,
  CAST(sum(coalesce(f.n, 0)) OVER (PARTITION BY d.label ORDER BY d.day) AS BIGINT) AS values_so_far
FROM days d LEFT JOIN fresh f USING (label, day) QUALIFY d.day >= DATE '2024-01-02'""")
def new_label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label values seen for the first time on each day; below 4,096 values a sketch is exact."""
    events = table(spark, sf_dir, "events").withColumn("user", F.col("user_id").cast("string"))
    states = _stored(sketches.label_states(events, ["event_type", "user"]), spark, "label-states")
    return sketches.new_values(states, since="2024-01-02")
