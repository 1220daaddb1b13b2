"""Time-series queries as dashboards ask them, over counters and gauges made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.display import format_unit, legend as legend_text, threshold_state as state_of
from ..functions.labels import select_series as select
from ..functions.timeaxis import calendar
from ..operators import histogram, panels, ranges, vectors
from ..operators.samples import bucket_counts, to_bucket_counters, to_counter
from . import inputs, query
from .inputs import (
    BOUNDS, BUCKET_COUNTERS_SQL, COUNTERS_SQL, GAUGES_SQL, SERIES, TYPE_COUNTERS_SQL,
    increase_sql, instant_sql, table,
)

_TYPE = ["event_type"]
_INCREASE_6H = increase_sql("grown", "counters", SERIES, "6 hours", "1 hour")
_RATE_1H = increase_sql("rates", "counters", SERIES, "1 hour", "15 minutes", "/ 3600.0")
_TYPE_RATE_1H = increase_sql("rates", "counters", _TYPE, "1 hour", "5 minutes", "/ 3600.0")
_NOW_1H = instant_sql("now", "gauges", SERIES, "15 minutes", "1 hour")


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.rate(inputs.counters(spark, sf_dir, "minute"), SERIES, "1h", "15m", unique=True, minute="minute")


def _type_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.rate(inputs.type_counters(spark, sf_dir, "minute"), _TYPE, "1h", "5m", unique=True, minute="minute")


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.instant(inputs.gauges(spark, sf_dir), SERIES, "15m", "1h")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {GAUGES_SQL}
SELECT event_type, user_bucket, region, ts, value FROM gauges
WHERE regexp_full_match(event_type, 'p.*|sign.*|vie') AND region <> ''
  AND user_bucket <> '7' AND user_bucket <> ''""")
def select_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(inputs.gauges(spark, sf_dir), [
        ("event_type", "=~", "p.*|sign.*|vie"), ("region", "!=", ""),
        ("user_bucket", "!=", "7"), ("user_bucket", "=~", ".+"),
    ])


@query(f"""WITH {GAUGES_SQL}
SELECT event_type, count(*) AS samples FROM gauges
WHERE coalesce(region, '') = '' AND event_type = 'click' GROUP BY 1""")
def select_missing_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select(inputs.gauges(spark, sf_dir), [("region", "=", ""), ("event_type", "=", "click")])
    return chosen.groupBy("event_type").agg(F.count(F.lit(1)).alias("samples"))


@query(f"WITH {COUNTERS_SQL}, {_INCREASE_6H} SELECT * FROM grown")
def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.increase(inputs.counters(spark, sf_dir), SERIES, "6h", "1h", unique=True)


@query(f"""WITH {COUNTERS_SQL}, {increase_sql("grown", "counters", SERIES, "1 hour", "1 hour")}
SELECT event_type, step, sum(value) AS value FROM grown GROUP BY 1, 2""")
def increase_1h_sum_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = ranges.increase(inputs.counters(spark, sf_dir), SERIES, "1h", "1h", unique=True)
    return vectors.agg(grown, "sum", _TYPE)


@query(f"WITH {COUNTERS_SQL}, {_RATE_1H} SELECT event_type, user_bucket, step, round(value, 9) AS value FROM rates")
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rates(spark, sf_dir), "value", digits=9)


@query(f"""WITH {TYPE_COUNTERS_SQL}, {increase_sql("rates", "counters", _TYPE, "5 minutes", "1 minute", "/ 300.0")}
SELECT event_type, step, round(value, 9) AS value FROM rates""")
def rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = inputs.type_counters(spark, sf_dir, "minute")
    return _rounded(ranges.rate(samples, _TYPE, "5m", "1m", unique=True, minute="minute"), "value", digits=9)


@query(f"""WITH counters AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(user_id % 40 AS VARCHAR) END AS series, ts,
    CAST(count(*) OVER (PARTITION BY CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(user_id % 40 AS VARCHAR) END, CAST(ts AS DATE)
      ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value FROM events),
{increase_sql("rates", "counters", ["series"], "2 hours", "20 minutes", "/ 7200.0")}
SELECT series, step, round(value, 9) AS value FROM rates""")
def rate_skewed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the samples are of one series."""
    series = F.when(F.col("event_id") % 3 == 0, "hot").otherwise((F.col("user_id") % 40).cast("string"))
    samples = to_counter(table(spark, sf_dir, "events"), {"series": series}, minute="minute")
    return _rounded(ranges.rate(samples, ["series"], "2h", "20m", unique=True, minute="minute"), "value", digits=9)


@query(f"""WITH {COUNTERS_SQL}, doubled AS (SELECT * FROM counters UNION ALL SELECT * REPLACE (value - 0.5 AS value) FROM counters),
points AS (SELECT event_type, user_bucket, ts, max(value) AS value FROM doubled GROUP BY ALL),
{increase_sql("grown", "points", SERIES, "3 hours", "2 hours")} SELECT * FROM grown""")
def increase_repeated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples at each instant, and a window that is no multiple of the step."""
    samples = inputs.counters(spark, sf_dir)
    doubled = samples.unionByName(samples.withColumn("value", F.col("value") - 0.5))
    return ranges.increase(doubled, SERIES, "3h", "2h")


@query(f"""WITH {TYPE_COUNTERS_SQL}, recent AS (
  SELECT * FROM counters WHERE ts >= TIMESTAMP '2024-01-30 11:00:00' AND ts < TIMESTAMP '2024-01-30 18:00:00'),
{increase_sql("rates", "recent", _TYPE, "1 hour", "30 seconds", "/ 3600.0")}
SELECT event_type, step, round(value, 9) AS value FROM rates
WHERE step BETWEEN TIMESTAMP '2024-01-30 12:00:00' AND TIMESTAMP '2024-01-30 18:00:00'""")
def range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hours at the dashboard refresh interval."""
    # the events are read from the start of the counters' day, and not beyond the range
    samples = to_counter(table(spark, sf_dir, "events"), {"event_type": "event_type"},
                         since="2024-01-30 11:00:00", until="2024-01-30 18:00:00")
    result = ranges.range_query(
        samples, "2024-01-30 12:00:00", "2024-01-30 18:00:00",
        lambda samples: ranges.rate(samples, _TYPE, "1h", "30s", unique=True), reach="1h")
    return _rounded(result, "value", digits=9)


@query(f"WITH {COUNTERS_SQL}, {_INCREASE_6H} SELECT step, sum(value) AS value FROM grown GROUP BY 1")
def sum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = ranges.increase(inputs.counters(spark, sf_dir), SERIES, "6h", "1h", unique=True)
    return vectors.agg(grown, "sum")


@query(f"""WITH {COUNTERS_SQL}, {_RATE_1H}
SELECT event_type, step, round(sum(value), 9) AS value FROM rates GROUP BY 1, 2""")
def sum_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vectors.agg(_rates(spark, sf_dir), "sum", _TYPE), "value", digits=9)


@query(f"WITH {GAUGES_SQL}, {_NOW_1H} SELECT event_type, step, max(value) AS value FROM now GROUP BY 1, 2")
def max_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.agg(_now(spark, sf_dir), "max", _TYPE)


@query(f"WITH {GAUGES_SQL}, {_NOW_1H} SELECT step, round(avg(value), 9) AS value FROM now GROUP BY 1")
def avg_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vectors.agg(_now(spark, sf_dir), "avg"), "value", digits=9)


@query(f"""WITH {GAUGES_SQL}, {_NOW_1H}
SELECT user_bucket, step, CAST(count(*) AS DOUBLE) AS value FROM now GROUP BY 1, 2""")
def count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.agg(_now(spark, sf_dir), "count", ["user_bucket"])


@query(f"""WITH {TYPE_COUNTERS_SQL}, {_TYPE_RATE_1H}
SELECT step, round(100 * sum(value) FILTER (WHERE event_type = 'error') / greatest(sum(value), 0.001), 6) AS value
FROM rates GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') > 0""")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 * sum(rate(errors)) / clamp_min(sum(rate(all)), 0.001) in one pass."""
    part = vectors.share(_type_rates(spark, sf_dir), F.col("event_type") == "error", floor=0.001)
    return part.select("step", F.round(100 * F.col("value"), 6).alias("value"))


@query(f"""WITH {GAUGES_SQL}, {_NOW_1H},
idle AS (SELECT step, sum(value) AS v FROM now WHERE event_type = 'view' GROUP BY 1),
whole AS (SELECT step, sum(value) AS v FROM now GROUP BY 1)
SELECT step, round(idle.v / nullif(whole.v, 0), 6) AS value FROM idle JOIN whole USING (step)""")
def utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of two label-less sums."""
    return _rounded(vectors.share(_now(spark, sf_dir), F.col("event_type") == "view"), "value")


@query(f"""WITH {COUNTERS_SQL}, {_RATE_1H},
a AS (SELECT user_bucket, step, sum(value) AS v FROM rates WHERE event_type = 'purchase' GROUP BY 1, 2),
b AS (SELECT user_bucket, step, sum(value) AS v FROM rates GROUP BY 1, 2)
SELECT user_bucket, step, round(a.v / nullif(b.v, 0), 6) AS value FROM a JOIN b USING (user_bucket, step)""")
def vector_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = vectors.share(_rates(spark, sf_dir), F.col("event_type") == "purchase", ["user_bucket"])
    return _rounded(bought, "value")


@query(f"""WITH {GAUGES_SQL}, {_NOW_1H}
SELECT a.user_bucket, step, a.value - b.value AS value FROM now a JOIN now b USING (user_bucket, step)
WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def vector_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vectors joined by their labels and the step."""
    now = _now(spark, sf_dir)
    a, b = (select(now, [("event_type", "=", t)]).drop("event_type") for t in ("click", "view"))
    return vectors.vector_op(a, b, "-")


@query(f"""WITH {GAUGES_SQL}, {_NOW_1H}
SELECT a.step, round(sum(a.value + b.value + c.value), 6) AS value
FROM now a JOIN now b ON a.user_bucket = b.user_bucket AND a.step = b.step AND b.event_type = 'view'
JOIN now c ON a.user_bucket = c.user_bucket AND a.step = c.step AND c.event_type = 'error'
WHERE a.event_type = 'click' GROUP BY 1""")
def vector_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sum(a + b + c) of three metrics; steps where one is missing drop."""
    parts = {t: F.col("event_type") == t for t in ("click", "view", "error")}
    total = vectors.combine(
        _now(spark, sf_dir), parts, lambda part: part["click"] + part["view"] + part["error"], ["user_bucket"])
    return _rounded(vectors.agg(total, "sum"), "value")


@query(f"WITH {GAUGES_SQL}, {_NOW_1H} SELECT * FROM now")
def instant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _now(spark, sf_dir)


@query(f"""WITH {GAUGES_SQL}
SELECT event_type, user_bucket, TIMESTAMP '2024-01-15 12:00:00' AS step, arg_max(value, ts) AS value
FROM gauges WHERE ts >= TIMESTAMP '2024-01-15 06:00:00' AND ts < TIMESTAMP '2024-01-15 12:00:00'
GROUP BY 1, 2""")
def instant_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.instant_at(inputs.gauges(spark, sf_dir), SERIES, "2024-01-15 12:00:00", "6h")


@query(f"""WITH {COUNTERS_SQL}, {_INCREASE_6H},
sums AS (SELECT user_bucket, step, sum(value) AS value FROM grown GROUP BY 1, 2)
SELECT user_bucket, step, value FROM sums
QUALIFY row_number() OVER (PARTITION BY step ORDER BY value DESC, user_bucket) <= 3""")
def topk_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = ranges.increase(inputs.counters(spark, sf_dir), SERIES, "6h", "1h", unique=True)
    return vectors.topk(3, vectors.agg(grown, "sum", ["user_bucket"]))


@query(f"""WITH {COUNTERS_SQL}, {_RATE_1H}
SELECT step, round(sum(value) * 60, 6) AS value FROM rates WHERE event_type = 'signup' GROUP BY 1""")
def per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = vectors.agg(select(_rates(spark, sf_dir), [("event_type", "=", "signup")]), "sum")
    return total.select("step", F.round(F.col("value") * 60, 6).alias("value"))


@query(f"""WITH {GAUGES_SQL}, {_NOW_1H}
SELECT step, CAST(sum(1 - (value >= 10)::INT) AS DOUBLE) AS value FROM now GROUP BY 1""")
def targets_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sum(1 - up), a target being up when its last value is 10 or more."""
    up = _now(spark, sf_dir).withColumn("value", (F.col("value") >= 10).cast("double"))
    return vectors.agg(up.withColumn("value", 1 - F.col("value")), "sum")


def _quantile_sql(q: float, source: str, keys: str) -> str:
    return f"""shaped AS (
  SELECT *, lag(le) OVER w AS lower_bound, coalesce(lag(value) OVER w, 0) AS below,
         max(value) OVER (PARTITION BY {keys}) AS total
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY le))
SELECT {keys}, round(arg_min(
         CASE WHEN total <= 0 THEN NULL
              WHEN le = CAST('infinity' AS DOUBLE) THEN lower_bound
              ELSE coalesce(lower_bound, 0) + (le - coalesce(lower_bound, 0))
                   * (({q} * total - below) / nullif(value - below, 0)) END, le), 6) AS value
FROM shaped WHERE value >= {q} * total GROUP BY ALL"""


@query(f"""WITH {BUCKET_COUNTERS_SQL},
{increase_sql("rates", "bucket_counters", ["event_type", "le"], "6 hours", "1 hour", "/ 21600.0")},
{_quantile_sql(0.95, "rates", "event_type, step")}""")
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = ranges.rate(
        inputs.bucket_counters(spark, sf_dir), ["event_type", "le"], "6h", "1h", unique=True)
    return _rounded(histogram.histogram_quantile(0.95, buckets, ["event_type"]), "value")


@query(f"""WITH buckets AS (
  SELECT event_type, b.le, CAST(count(*) FILTER (WHERE value <= b.le) AS DOUBLE) AS value
  FROM events, (VALUES (CAST(10 AS DOUBLE)), (25), (50), (100), (250), (500),
                       (CAST('infinity' AS DOUBLE))) AS b(le) GROUP BY ALL),
{_quantile_sql(0.5, "buckets", "event_type")}""")
def histogram_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = bucket_counts(table(spark, sf_dir, "events"), ["event_type"], "value", BOUNDS)
    return _rounded(histogram.histogram_quantile(0.5, buckets, ["event_type"]), "value")


@query(f"""WITH buckets AS (
  SELECT o_orderpriority, date_trunc('month', o_orderdate) AS step, b.le,
         CAST(count(*) FILTER (WHERE o_totalprice <= b.le) AS DOUBLE) AS value
  FROM orders, (VALUES (CAST(50000 AS DOUBLE)), (100000), (200000), (400000),
                       (CAST('infinity' AS DOUBLE))) AS b(le) GROUP BY ALL),
{_quantile_sql(0.95, "buckets", "o_orderpriority, step")}""")
def histogram_quantile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("step", calendar("o_orderdate", "month"))
    bounds = [50000, 100000, 200000, 400000, float("inf")]
    buckets = bucket_counts(orders, ["o_orderpriority", "step"], "o_totalprice", bounds)
    return _rounded(histogram.histogram_quantile(0.95, buckets, ["o_orderpriority"]), "value")


@query(f"""WITH {TYPE_COUNTERS_SQL}, amounts AS (
  SELECT event_type, ts, sum(value) OVER (PARTITION BY event_type, CAST(ts AS DATE)
         ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events),
{increase_sql("rates", "counters", _TYPE, "6 hours", "1 hour", "/ 21600.0")},
{increase_sql("sums", "amounts", _TYPE, "6 hours", "1 hour", "/ 21600.0")}
SELECT event_type, step, round(s.value / nullif(r.value, 0), 8) AS value
FROM sums s JOIN rates r USING (event_type, step)""")
def histogram_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both counters are series of one vector: one scan, one rate."""
    kinds = F.array(F.struct(F.lit("sum").alias("kind"), F.col("value").alias("amount")),
                    F.struct(F.lit("count").alias("kind"), F.lit(1.0).alias("amount")))
    both = table(spark, sf_dir, "events").select("event_type", "ts", F.inline(kinds))
    samples = to_counter(both, {"event_type": "event_type", "kind": "kind"}, amount=F.col("amount"))
    rates = ranges.rate(samples, ["event_type", "kind"], "6h", "1h", unique=True)
    return _rounded(histogram.histogram_mean(rates, by=_TYPE), "value", digits=8)


_PANEL = [
    panels.Target("errors / {{user_bucket}}", [("event_type", "=", "error")], "increase", "6h", "sum", ["user_bucket"]),
    panels.Target("all / {{user_bucket}}", [], "increase", "6h", "sum", ["user_bucket"]),
    panels.Target("peak", [("event_type", "=~", "p.*|v.*")], "increase", "6h", "max"),
]
_PANEL_SQL = f"""WITH {COUNTERS_SQL}, {_INCREASE_6H}, panel AS (
SELECT 'errors / ' || user_bucket AS legend, step, sum(value) AS value FROM grown
WHERE event_type = 'error' GROUP BY 1, 2
UNION ALL SELECT 'all / ' || user_bucket, step, sum(value) FROM grown GROUP BY 1, 2
UNION ALL SELECT 'peak', step, max(value) FROM grown
WHERE event_type LIKE 'p%' OR event_type LIKE 'v%' GROUP BY 1, 2)"""


@query(f"{_PANEL_SQL} SELECT * FROM panel")
def panel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.panel(inputs.counters(spark, sf_dir), SERIES, _PANEL, "1h", unique=True)


@query(f"""{_PANEL_SQL}
SELECT legend, arg_max(value, step) AS last, round(avg(value), 6) AS mean, max(value) AS max
FROM panel GROUP BY 1""")
def panel_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = panels.panel(inputs.counters(spark, sf_dir), SERIES, _PANEL, "1h", unique=True)
    return _rounded(panels.reduce_series(shown), "mean")


@query(f"""{_PANEL_SQL.rsplit(", panel AS", 1)[0]}, sums AS (
  SELECT 'all / ' || user_bucket AS legend, step, sum(value) AS value FROM grown GROUP BY 1, 2)
SELECT legend, step, value FROM sums QUALIFY row_number() OVER (PARTITION BY step ORDER BY value DESC, legend) <= 2
UNION ALL SELECT 'peak', step, max(value) FROM grown GROUP BY 1, 2""")
def panel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [
        panels.Target("all / {{user_bucket}}", [], "increase", "6h", "sum", ["user_bucket"], k=2),
        panels.Target("peak", [], "increase", "6h", "max"),
    ]
    return panels.panel(inputs.counters(spark, sf_dir), SERIES, targets, "1h", unique=True)


@query(f"""WITH {BUCKET_COUNTERS_SQL}, amounts AS (
  SELECT event_type, ts, CAST(sum(v) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts) AS DOUBLE) AS value
  FROM (SELECT event_type, time_bucket(INTERVAL 1 MINUTE, ts) AS ts, sum(value) AS v FROM events GROUP BY 1, 2)),
{increase_sql("rates", "bucket_counters", ["event_type", "le"], "6 hours", "1 hour", "/ 21600.0")},
{increase_sql("sums", "amounts", ["event_type"], "6 hours", "1 hour", "/ 21600.0")},
rising AS (SELECT event_type, step, le, max(value) OVER (PARTITION BY event_type, step ORDER BY le) AS value FROM rates),
p50 AS ({_quantile_sql(0.5, "rising", "event_type, step").replace("shaped AS", "WITH shaped AS", 1)}),
p95 AS ({_quantile_sql(0.95, "rising", "event_type, step").replace("shaped AS", "WITH shaped AS", 1)})
SELECT event_type || ' p50' AS legend, step, value FROM p50
UNION ALL SELECT event_type || ' p95', step, value FROM p95
UNION ALL SELECT r.event_type || ' mean', r.step, round(s.value / nullif(r.value, 0), 6) FROM rising r
  LEFT JOIN sums s ON s.event_type = r.event_type AND s.step = r.step WHERE r.le = CAST('infinity' AS DOUBLE)""")
def panel_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 95th percentile and mean from one rate pass."""
    samples = to_bucket_counters(
        table(spark, sf_dir, "events"), {"event_type": "event_type"}, "value", BOUNDS, with_sum=True)
    lines = panels.histogram_panel(
        samples, _TYPE, {"p50": 0.5, "p95": 0.95}, _TYPE, "6h", "1h", mean="mean", unique=True)
    return _rounded(lines, "value")


@query(f"""WITH {GAUGES_SQL}
SELECT event_type || ' / ' || coalesce(region, '') AS legend, count(*) AS samples FROM gauges GROUP BY 1""")
def legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = inputs.gauges(spark, sf_dir).groupBy("event_type", "region").agg(
        F.count(F.lit(1)).alias("n"))
    return named.groupBy(legend_text("{{event_type}} / {{region}}").alias("legend")).agg(
        F.sum("n").alias("samples"))


@query("""SELECT event_id, CASE WHEN value >= 200 THEN 'red' WHEN value >= 80 THEN 'yellow' ELSE 'green' END AS state
FROM events""")
def threshold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [(None, "green"), (80, "yellow"), (200, "red")]
    return table(spark, sf_dir, "events").select("event_id", state_of("value", steps).alias("state"))


def _two_decimals(scaled: str) -> str:
    # decimal rounding of the shortest text of the double: halves go up
    return f"CAST(round(CAST(CAST({scaled} AS VARCHAR) AS DECIMAL(38,18)), 2) AS DECIMAL(38,2))::VARCHAR"


@query(f"""SELECT event_id,
  CASE WHEN value >= 3600 THEN {_two_decimals("value / 3600.0")} || ' hour'
       WHEN value >= 60 THEN {_two_decimals("value / 60.0")} || ' min'
       WHEN value >= 1 THEN {_two_decimals("value")} || ' s'
       WHEN value >= 0.001 THEN {_two_decimals("value / 0.001")} || ' ms'
       ELSE {_two_decimals("value / 0.000001")} || ' µs' END AS seconds,
  CASE WHEN b >= 1024 THEN {_two_decimals("b / 1024.0")} || ' KiB'
       ELSE {_two_decimals("b")} || ' B' END AS bytes,
  {_two_decimals("value")} || '%' AS percent
FROM (SELECT event_id, value, round(value * 37) AS b FROM events)""")
def format_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("b", F.round(F.col("value") * 37))
    return events.select(
        "event_id", format_unit("value", "s").alias("seconds"),
        format_unit("b", "bytes").alias("bytes"), format_unit("value", "percent").alias("percent"))
