"""Range functions against brute force, and the edge cases of the data model."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ranges
from tallyloom.functions.timeaxis import seconds

EPOCH = datetime(2024, 1, 1)
SCHEMA = "job string, ts timestamp_ntz, value double"


def at(offset):
    return EPOCH + timedelta(seconds=offset)


def frame(spark, rows):
    return spark.createDataFrame([(j, at(t), v) for j, t, v in rows], SCHEMA)


def result(df):
    return {
        (r["job"], (r["step"] - EPOCH).total_seconds()): round(r["value"], 6) for r in df.collect()
    }


def brute_increase(rows, window, step):
    series = {}
    for job, t, v in rows:
        points = series.setdefault(job or "", {})
        points[t] = max(v, points.get(t, v))
    out = {}
    for job, points in series.items():
        ordered = sorted(points.items())
        if not ordered:
            continue
        moment = (ordered[0][0] // step) * step
        while moment <= ordered[-1][0] + window + step:
            inside = [p for p in ordered if moment - window <= p[0] < moment]
            if len(inside) >= 2:
                grown = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:]))
                out[(job, float(moment))] = round(grown, 6)
            moment += step
    return out


def brute_instant(rows, lookback, step):
    series = {}
    for job, t, v in rows:
        points = series.setdefault(job, {})
        points[t] = max(v, points.get(t, v))
    out = {}
    for job, points in series.items():
        moment = (min(points) // step) * step
        while moment <= max(points) + lookback + step:
            inside = [t for t in points if moment - lookback <= t < moment]
            if inside:
                out[(job, float(moment))] = round(points[max(inside)], 6)
            moment += step
    return out


def random_rows(seed, count=150, span=4000):
    rng = random.Random(seed)
    rows = []
    for job in ("a", "b"):
        value = 0.0
        for t in sorted(rng.randrange(span) for _ in range(count if job == "a" else 12)):
            value = 0.0 if rng.random() < 0.1 else value + rng.randrange(10) / 4
            rows.append((job, t, value))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,step", [
    ("5m", "1m"), ("5m", "2m"), ("1m", "5m"), ("90s", "30s"), ("10m", "10m"), ("7s", "3s"), ("1h", "30s"),
])
def test_increase_equals_brute_force(spark, window, step):
    rows = random_rows(seconds(window))
    found = result(ranges.increase(frame(spark, rows), ["job"], window, step))
    assert found == brute_increase(rows, seconds(window), seconds(step))


@pytest.mark.parametrize("lookback,step", [("5m", "1m"), ("5m", "2m"), ("1m", "5m"), ("7s", "3s")])
@pytest.mark.parametrize("unique", [False, True])
def test_instant_equals_brute_force(spark, lookback, step, unique):
    rows = random_rows(7)
    if unique:
        rows = [(j, t, v) for (j, t), v in {(j, t): v for j, t, v in rows}.items()]
    found = result(ranges.instant(frame(spark, rows), ["job"], step, lookback, unique=unique))
    assert found == brute_instant(rows, seconds(lookback), seconds(step))


def test_partitioning_and_order_do_not_matter(spark):
    rows = random_rows(3)
    once = frame(spark, rows).repartition(1)
    many = frame(spark, rows[::-1]).repartition(11)
    assert result(ranges.rate(once, ["job"])) == result(ranges.rate(many, ["job"]))


def test_disjoint_windows_and_seams_add_up(spark):
    rows = [("a", t, float(t)) for t in range(0, 3600, 20)]
    grown = result(ranges.increase(frame(spark, rows), ["job"], "10m", "10m"))
    assert sum(grown.values()) + 20 * (len(grown) - 1) == 3580


def test_empty_and_single_sample_give_nothing(spark):
    assert result(ranges.increase(frame(spark, []), ["job"], "5m")) == {}
    assert result(ranges.increase(frame(spark, [("a", 5, 1.0)]), ["job"], "5m")) == {}
    assert result(ranges.instant(frame(spark, []), ["job"])) == {}


def test_reset_to_zero_counts_from_zero(spark):
    rows = [("a", 0, 10.0), ("a", 10, 14.0), ("a", 20, 0.0), ("a", 30, 3.0)]
    assert result(ranges.increase(frame(spark, rows), ["job"], "1m", "1m")) == {("a", 60.0): 7.0}


def test_equal_timestamps_are_one_sample(spark):
    rows = [("a", 0, 1.0), ("a", 0, 2.0)]
    assert result(ranges.increase(frame(spark, rows), ["job"], "1m", "1m")) == {}
    rows.append(("a", 30, 5.0))
    assert result(ranges.increase(frame(spark, rows), ["job"], "1m", "1m")) == {("a", 60.0): 3.0}


def test_missing_and_empty_label_are_one_series(spark):
    rows = [(None, 0, 1.0), ("", 30, 4.0)]
    assert result(ranges.increase(frame(spark, rows), ["job"], "1m", "1m")) == {("", 60.0): 3.0}


def test_fractional_growth_survives_a_large_jump(spark):
    rows = [("a", 0, 1e15), ("a", 61, 0.25), ("a", 62, 0.5), ("a", 121, 0.75)]
    found = result(ranges.increase(frame(spark, rows), ["job"], "2m", "1m"))
    assert found[("a", 180.0)] == 0.5


def test_timestamps_with_time_zone(spark):
    rows = random_rows(5)
    zoned = frame(spark, rows).withColumn("ts", F.col("ts").cast("timestamp"))
    found = ranges.rate(zoned, ["job"])
    assert dict(found.dtypes)["step"] == "timestamp"
    assert found.count() == ranges.rate(frame(spark, rows), ["job"]).count()


def test_range_query_reads_only_what_it_needs(spark, folder):
    path = folder("samples")
    frame(spark, random_rows(9)).write.parquet(path)
    query = ranges.range_query(
        spark.read.parquet(path), "2024-01-01 00:30:00", "2024-01-01 00:40:00",
        lambda s: ranges.rate(s, ["job"], "5m", "1m"), "5m")
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-01T00:25" in plan
    full = {k: v for k, v in result(ranges.rate(frame(spark, random_rows(9)), ["job"], "5m", "1m")).items()
            if 1800 <= k[1] <= 2400}
    assert result(query) == full


def test_instant_at(spark):
    rows = [("a", 0, 1.0), ("a", 50, 2.0), ("a", 60, 3.0), ("b", 0, 9.0)]
    found = ranges.instant_at(frame(spark, rows), ["job"], "2024-01-01 00:01:00", "1m")
    assert result(found) == {("a", 60.0): 2.0, ("b", 60.0): 9.0}
