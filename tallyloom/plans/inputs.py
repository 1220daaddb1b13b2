"""Samples, logs and other inputs the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.prefix import sequence_number
from ..operators.samples import to_bucket_counters, to_counter

BOUNDS = [10.0, 25.0, 50.0, 100.0, 250.0, 500.0, float("inf")]
SERIES = ["event_type", "user_bucket"]
LOG_PARTITIONS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counters(spark: SparkSession, sf_dir: str, minute: str | None = None) -> DataFrame:
    """Running event count per type and user bucket, starting again each day."""
    return to_counter(
        table(spark, sf_dir, "events"),
        {"event_type": "event_type", "user_bucket": F.col("user_id") % 8}, minute=minute,
    )


def type_counters(spark: SparkSession, sf_dir: str, minute: str | None = None) -> DataFrame:
    return to_counter(table(spark, sf_dir, "events"), {"event_type": "event_type"}, minute=minute)


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event value as a gauge; ``region`` is missing, empty or set."""
    region = (
        F.when(F.col("user_id") % 4 == 1, "")
        .when(F.col("user_id") % 4 == 2, "eu-west")
        .when(F.col("user_id") % 4 == 3, "us-east")
    )
    return table(spark, sf_dir, "events").select(
        "event_type", (F.col("user_id") % 8).cast("string").alias("user_bucket"),
        region.alias("region"), "ts", "value")


def bucket_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bucket_counters(
        table(spark, sf_dir, "events"), {"event_type": "event_type"}, "value", BOUNDS)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a partitioned log in id order, which is their time order."""
    events = table(spark, sf_dir, "events").withColumn(
        "partition", F.pmod(F.col("user_id"), F.lit(LOG_PARTITIONS)))
    numbered = sequence_number(events, ["partition"], "event_id", "_n")
    return numbered.select(
        F.lit("events").alias("topic"), "partition", (F.col("_n") - 1).alias("offset"),
        F.col("user_id").alias("key"), F.col("props").alias("value"),
        F.col("ts").alias("timestamp"), "event_id")


def commits(end_of_log: DataFrame) -> DataFrame:
    """Three groups: at the end, at 80%, and one without a commit for the last partition."""
    ends = end_of_log.groupBy("partition").agg((F.max("offset") + 1).alias("_end"))
    done = F.array(
        F.struct(F.lit("current").alias("group"), F.col("_end").alias("offset")),
        F.struct(F.lit("behind").alias("group"), F.floor(F.col("_end") * 4 / 5).alias("offset")),
        F.struct(F.lit("partial").alias("group"),
                 F.when(F.col("partition") < LOG_PARTITIONS - 1, F.col("_end")).alias("offset")),
    )
    return (
        ends.select("partition", F.explode(done).alias("_c")).select("partition", "_c.*")
        .filter(F.col("offset").isNotNull())
    )


# The same inputs for the SQL side, as common table expressions.

COUNTERS_SQL = """counters AS (
  SELECT event_type, CAST(user_id % 8 AS VARCHAR) AS user_bucket, ts,
         CAST(count(*) OVER (PARTITION BY event_type, user_id % 8, CAST(ts AS DATE)
                             ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value
  FROM events)"""

TYPE_COUNTERS_SQL = """counters AS (
  SELECT event_type, ts,
         CAST(count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE)
                             ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value
  FROM events)"""

GAUGES_SQL = """gauges AS (
  SELECT event_type, CAST(user_id % 8 AS VARCHAR) AS user_bucket,
         CASE user_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'eu-west' WHEN 3 THEN 'us-east' END AS region,
         ts, value
  FROM events)"""

BUCKET_COUNTERS_SQL = """scrapes AS (
  SELECT event_type, b.le, time_bucket(INTERVAL 1 MINUTE, ts) AS ts,
         count(*) FILTER (WHERE value <= b.le) AS n
  FROM events, (VALUES (CAST(10 AS DOUBLE)), (25), (50), (100), (250), (500),
                       (CAST('infinity' AS DOUBLE))) AS b(le)
  GROUP BY ALL),
bucket_counters AS (
  SELECT event_type, le, ts,
         CAST(sum(n) OVER (PARTITION BY event_type, le, CAST(ts AS DATE) ORDER BY ts) AS DOUBLE) AS value
  FROM scrapes)"""

LOG_SQL = """log AS (
  SELECT user_id % 4 AS "partition",
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS "offset",
         user_id AS key, props AS value, ts AS "timestamp", event_id
  FROM events)"""

COMMITS_SQL = """ends AS (SELECT "partition", max("offset") + 1 AS e FROM log GROUP BY 1),
commits AS (
  SELECT 'current' AS "group", "partition", e AS "offset" FROM ends
  UNION ALL SELECT 'behind', "partition", CAST(floor(e * 4 / 5) AS BIGINT) FROM ends
  UNION ALL SELECT 'partial', "partition", e FROM ends WHERE "partition" < 3)"""


def increase_sql(name: str, source: str, labels: list[str], window: str, step: str, per: str = "") -> str:
    """CTE ``name``: growth per series over the window, on the grid; ``per`` divides it."""
    keys = ", ".join(labels)
    return f"""{name}_pairs AS (
  SELECT *, lag(ts) OVER w AS before_ts,
         CASE WHEN lag(value) OVER w IS NULL THEN 0
              WHEN value < lag(value) OVER w THEN value
              ELSE value - lag(value) OVER w END AS growth
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY ts)),
{name}_grid AS (
  SELECT *, unnest(generate_series(time_bucket(INTERVAL '{step}', ts) + INTERVAL '{step}',
                                   ts + INTERVAL '{window}', INTERVAL '{step}')) AS step
  FROM {name}_pairs),
{name} AS (
  SELECT {keys}, step,
         CAST(sum(CASE WHEN before_ts >= step - INTERVAL '{window}' THEN growth ELSE 0 END) AS DOUBLE)
         {per} AS value
  FROM {name}_grid GROUP BY ALL HAVING count(*) >= 2)"""


def instant_sql(name: str, source: str, labels: list[str], step: str, lookback: str) -> str:
    """CTE ``name``: last sample of each series within the lookback, on the grid."""
    keys = ", ".join(labels)
    return f"""{name}_grid AS (
  SELECT *, unnest(generate_series(time_bucket(INTERVAL '{step}', ts) + INTERVAL '{step}',
                                   ts + INTERVAL '{lookback}', INTERVAL '{step}')) AS step
  FROM {source}),
{name} AS (
  SELECT {keys}, step, arg_max(value, ts) AS value FROM {name}_grid GROUP BY ALL)"""
