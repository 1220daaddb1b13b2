"""Join queries over orders, line items, parts, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import asof, joins
from ..functions.timeaxis import floor_time
from . import query
from .inputs import table


@query("""SELECT c_mktsegment, count(*) AS events FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1 ORDER BY events DESC, 1 LIMIT 20""")
def fact_dim_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.fact_dim_topn(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey",
        "c_mktsegment", when=F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))


@query("""SELECT p_brand, count(*) AS events FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1 ORDER BY events DESC, 1 LIMIT 20""")
def fact_dim_topn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.fact_dim_topn(
        table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), "l_partkey", "p_partkey", "p_brand")


@query("""WITH app_rows AS (SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL),
recent AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT o_orderpriority, CAST(sum(n) AS BIGINT) AS events FROM app_rows JOIN recent USING (id) GROUP BY 1""")
def preagg_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.preagg_join(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey",
        "o_orderpriority", when=F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))


@query("""WITH app_rows AS (SELECT l_suppkey AS id, l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL),
recent AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS events FROM app_rows JOIN recent USING (id) GROUP BY 1""")
def preagg_join_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids repeat on both sides."""
    items = table(spark, sf_dir, "lineitem")
    return joins.preagg_join(
        items, items, "l_suppkey", "l_suppkey", "l_returnflag", when=F.col("l_linestatus") == "O")


@query("""SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def missing_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an open order and without an urgent one."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.missing_from(
        customers, orders.filter("o_orderstatus = 'O'"), orders.filter("o_orderpriority = '1-URGENT'"),
        ["c_custkey"])


@query("""WITH up AS (SELECT o_custkey AS target, arg_max(price, o) AS price FROM (
  SELECT o_custkey, o_totalprice AS price, (o_orderdate, o_totalprice) AS o FROM orders
  WHERE o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1)
SELECT c_custkey AS target, CASE WHEN price IS NULL THEN 'missing' WHEN price > 200000 THEN 'up' ELSE 'down' END AS status
FROM customer LEFT JOIN up ON target = c_custkey""")
def target_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as targets; one is up when its last order is above 200000."""
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"))
    recent = table(spark, sf_dir, "orders").filter(
        F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    up = recent.select(F.col("o_custkey").alias("target"), F.col("o_orderdate").alias("ts"),
                       (F.col("o_totalprice") - 200000).alias("value"))
    return joins.target_status(expected, up, ["target"])


_ASOF_SQL = """WITH o AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey % 150 END AS user_id,
    TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) % 720) AS at FROM orders),
e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id,
  time_bucket(INTERVAL 10 MINUTE, ts) AS ts, value FROM events WHERE event_type <> 'view'),
pairs AS (SELECT o.*, e.ts, e.event_id, e.value FROM o JOIN e ON e.user_id = o.user_id AND {when}
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY e.ts DESC, event_id DESC) = 1)"""


def _orders_and_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders put into the month of the events; a third of both sides has one user, and times repeat."""
    hour = (F.datediff("o_orderdate", F.lit("1995-01-01")) % 720) * F.expr("interval 1 hour")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_custkey") % 150).alias("user_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + hour).alias("at"))
    events = table(spark, sf_dir, "events").filter("event_type <> 'view'").select(
        F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id")).alias("user_id"),
        floor_time("ts", "10m").alias("ts"), "event_id", "value")
    return orders, events


@query(_ASOF_SQL.format(when="e.ts <= o.at") + """
SELECT o.o_orderkey, o.user_id, o.at, p.ts, p.event_id, p.value FROM o LEFT JOIN pairs p USING (o_orderkey)""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each order's user up to it, however long ago; ties go to the larger id."""
    orders, events = _orders_and_events(spark, sf_dir)
    return asof.asof_join(orders, events, ["user_id"], "at", "ts")


@query(_ASOF_SQL.format(when="e.ts < o.at AND e.ts >= o.at - INTERVAL 2 HOUR") + """
SELECT o_orderkey, user_id, "at", ts, event_id, value FROM pairs""")
def asof_join_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only events before the order and at most two hours ago; orders without one are left out."""
    orders, events = _orders_and_events(spark, sf_dir)
    return asof.asof_join(orders, events, ["user_id"], "at", "ts", within="2h", how="inner", strict=True)
