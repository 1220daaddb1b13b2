"""Event-table queries: profiles, rates, rollups, typed payloads, names and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.records import (payload_drift as drift, relabel as apply_rules, stable_id as id_of, typed_props as typed,
                                 variant_props as variants)
from ..functions.timeaxis import calendar, floor_time, interval
from ..operators import events as ev
from ..session import scratch_path
from ..sources import tables
from . import inputs, query
from .inputs import GAUGES_SQL, table

# "now" of every query on events
AS_OF = "2024-01-31 00:00:00"


def _since(days: int):
    return F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz") - interval(f"{days}d")


@query("""SELECT event_type, count(*) AS events, round(quantile_cont(value, 0.95), 9) AS p95
FROM events GROUP BY 1""")
def latency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = ev.latency_profile(table(spark, sf_dir, "events"), ["event_type"], "value")
    return profile.withColumn("p95", F.round("p95", 9))


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events,
  round(quantile_cont(value, 0.95), 9) AS p95 FROM events
WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1, 2""")
def latency_profile_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days by hour and event, time range and events pushed to the scan."""
    recent = (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("click", "view") & _since(7))
        .select(floor_time("ts", "1h").alias("hour"), "event_type", "value")
    )
    profile = ev.latency_profile(recent, ["hour", "event_type"], "value")
    return profile.withColumn("p95", F.round("p95", 9))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS events, round(quantile_cont(l_extendedprice, 0.5), 6) AS median
FROM lineitem GROUP BY 1, 2""")
def price_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = ev.latency_profile(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.5, "median")
    return profile.withColumn("median", F.round("median", 6))


@query("SELECT event_type, count(*) AS events, true AS within FROM events GROUP BY 1")
def latency_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rank of the sketched quantile is within a hundredth of 0.95."""
    events = table(spark, sf_dir, "events")
    sketch = ev.latency_profile(events, ["event_type"], "value", exact=False).select("event_type", "p95")
    ranked = events.join(sketch, "event_type").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("value") < F.col("p95")).alias("_below"),
        F.count_if(F.col("value") <= F.col("p95")).alias("_up_to"))
    within = (F.col("_below") <= 0.96 * F.col("events")) & (F.col("_up_to") >= 0.94 * F.col("events"))
    return ranked.select("event_type", "events", within.alias("within"))


@query("""SELECT o_orderpriority, count(*) AS rows,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / nullif(count(*), 0), 9) AS success_rate
FROM orders GROUP BY 1""")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = ev.success_rate(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")
    return rates.withColumn("success_rate", F.round("success_rate", 9))


@query("""WITH pairs AS (
  SELECT 'event_type' AS label, event_type AS v FROM events
  UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT 'region', CASE user_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'eu-west' WHEN 3 THEN 'us-east' END FROM events
  UNION ALL SELECT 'props', props FROM events)
SELECT label, count(DISTINCT v) AS distinct_values, count(DISTINCT v) > 100 AS unbounded
FROM pairs WHERE v <> '' GROUP BY 1""")
def label_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.when(F.col("user_id") % 4 == 1, "").when(F.col("user_id") % 4 == 2, "eu-west").when(
        F.col("user_id") % 4 == 3, "us-east")
    samples = table(spark, sf_dir, "events").withColumn("region", region)
    return ev.label_cardinality(samples, ["event_type", "user_id", "region", "props"])


@query("""WITH doubled AS (SELECT * FROM events UNION ALL SELECT * REPLACE (NULL AS props) FROM events WHERE event_id % 10 = 0),
k AS (SELECT event_id, count(*) AS n FROM doubled GROUP BY 1)
SELECT count(*) AS rows, count(*) FILTER (WHERE event_id IS NULL) AS nulls_event_id,
  count(*) FILTER (WHERE ts IS NULL) AS nulls_ts, count(*) FILTER (WHERE user_id IS NULL) AS nulls_user_id,
  count(*) FILTER (WHERE event_type IS NULL) AS nulls_event_type, count(*) FILTER (WHERE value IS NULL) AS nulls_value,
  count(*) FILTER (WHERE props IS NULL) AS nulls_props,
  count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')) AS unexpected_event_type,
  (SELECT count(*) FROM k WHERE n > 1) AS duplicate_keys, min(ts) AS first_ts, max(ts) AS last_ts FROM doubled""")
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    copies = events.filter("event_id % 10 = 0").withColumn("props", F.lit(None).cast("string"))
    return ev.profile(events.unionByName(copies), ["event_id"],
                      {"event_type": ["click", "view", "purchase", "signup"]}, "ts")


@query("SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.freshness(table(spark, sf_dir, "events"), "ts", ["event_type"])


@query("""SELECT CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS bucket, event_type, count(*) AS rows,
  round(sum(value), 6) AS total, round(avg(value), 9) AS mean FROM events GROUP BY 1, 2, 3""")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built without the late rows, then refreshed for the days they fall in."""
    events = table(spark, sf_dir, "events")
    late = F.col("event_id") % 97 == 0
    path = scratch_path(spark, "rollup")
    on_time = events.filter(~late)
    tables.refresh_rollup(on_time, on_time, path, ["event_type"], "value")
    tables.refresh_rollup(events, events.filter(late), path, ["event_type"], "value")
    return spark.read.parquet(path).select(
        "day", "bucket", "event_type", "rows", F.round("total", 6).alias("total"), F.round("mean", 9).alias("mean"))


@query("""SELECT date_trunc('day', o_orderdate) AS day, o_orderstatus, count(*) AS run_count,
  round(avg(o_totalprice), 6) AS avg_duration FROM orders GROUP BY 1, 2""")
def daily_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(calendar("o_orderdate", "day").alias("day"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("run_count"), F.round(F.avg("o_totalprice"), 6).alias("avg_duration"))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS rows FROM events
WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY 1, 2""")
def recent_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "events").filter(_since(14))
    return recent.groupBy(calendar("ts", "day").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1 ORDER BY rows DESC")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc())


@query("""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def recent_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
        .select("o_orderkey", "o_orderdate", "o_totalprice")
        .orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(20)
    )


@query("""SELECT event_type, CAST(event_id % 10 AS BIGINT) AS bucket, count(*) AS rows,
  round(sum(exp(-value / 5)), 6) AS decayed FROM events GROUP BY 1, 2""")
def modulo_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 10).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.exp(-F.col("value") / 5)), 6).alias("decayed"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 'web' AS channel FROM events""")
def typed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return typed(events, "k int, channel string", defaults={"channel": "web"})


_RULES = [
    (r"shop\.events<type=(click|view), name=Bucket(\d+)><>Count", "Shop_$1_Bucket$2_total", "COUNTER"),
    (r"shop\.events<type=(\w+), name=Bucket[0-3]><>Count", "Shop_$1_Low_total", "COUNTER"),
    (r"shop\.events<type=error, name=(\w+)><>Count", "Shop_Errors", "GAUGE"),
]


@query(r"""WITH named AS (SELECT value, 'shop.events<type=' || event_type || ', name=Bucket' || (user_id % 8) || '><>Count' AS s FROM events),
ruled AS (SELECT value,
  CASE WHEN regexp_matches(s, 'shop\.events<type=(click|view), name=Bucket(\d+)><>Count')
         THEN lower(regexp_replace(s, '.*type=(\w+), name=Bucket(\d+).*', 'Shop_\1_Bucket\2_total'))
       WHEN regexp_matches(s, 'shop\.events<type=(\w+), name=Bucket[0-3]><>Count')
         THEN lower(regexp_replace(s, '.*type=(\w+),.*', 'Shop_\1_Low_total'))
       WHEN regexp_matches(s, 'shop\.events<type=error, name=(\w+)><>Count') THEN 'shop_errors' END AS metric,
  CASE WHEN regexp_matches(s, 'type=(click|view)|Bucket[0-3]') THEN 'counter' ELSE 'gauge' END AS kind FROM named)
SELECT metric, kind, count(*) AS samples, round(sum(value), 6) AS total FROM ruled WHERE metric IS NOT NULL GROUP BY 1, 2""")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    named = events.select("value", F.concat(
        F.lit("shop.events<type="), "event_type", F.lit(", name=Bucket"),
        (F.col("user_id") % 8).cast("string"), F.lit("><>Count")).alias("source_name"))
    return apply_rules(named, _RULES).groupBy("metric", "kind").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 6).alias("total"))


@query("""SELECT event_id, substr(sha256(concat_ws('|', user_id, event_type,
  CASE WHEN event_id % 3 = 0 THEN 'None' ELSE props END)), 1, 16) AS id FROM events""")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    sometimes = F.when(F.col("event_id") % 3 != 0, F.col("props"))
    return events.select("event_id", id_of(["user_id", "event_type", sometimes]).alias("id"))


def _drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose payload has one of four shapes: a number, a number in quotes, a further object, no JSON."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    shape = F.col("event_id") % 4
    props = (
        F.when(shape == 0, F.concat(F.lit('{"k": '), k, F.lit("}"))).when(shape == 1, F.concat(F.lit('{"k": "'), k, F.lit('"}')))
        .when(shape == 2, F.concat(F.lit('{"k": '), k, F.lit(', "extra": {"x": 1.5}}'))).otherwise(F.concat(F.lit("k="), k)))
    return table(spark, sf_dir, "events").select("event_id", "event_type", shape.alias("shape"), props.alias("props"))


_K = "CAST(json_extract(props, '$.k') AS INTEGER)"


@query(f"""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN {_K} END AS k, CASE WHEN event_id % 4 = 2 THEN 1.5::DOUBLE END AS x FROM events""")
def variant_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of several shapes, typed while they are read."""
    fields = {"k": ("$.k", "int"), "x": ("$.extra.x", "double")}
    return variants(_drifting(spark, sf_dir).select("event_id", "props"), fields)


@query("""SELECT event_id % 4 AS shape, count(*) AS records, count(*) FILTER (WHERE event_id % 4 = 3) AS unreadable,
  CASE event_id % 4 WHEN 0 THEN 'OBJECT<k: BIGINT>' WHEN 1 THEN 'OBJECT<k: STRING>'
    WHEN 2 THEN 'OBJECT<extra: OBJECT<x: DECIMAL(2,1)>, k: BIGINT>' ELSE 'VOID' END AS payload_type FROM events GROUP BY 1, 4
UNION ALL SELECT -1, count(*), count(*) FILTER (WHERE event_id % 4 = 3), 'OBJECT<extra: OBJECT<x: DECIMAL(2,1)>, k: VARIANT>' FROM events""")
def payload_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of the payloads of each shape, and of all together."""
    rows = _drifting(spark, sf_dir)
    return drift(rows, ["shape"]).unionByName(drift(rows.withColumn("shape", F.lit(-1).cast("long")), ["shape"]))
