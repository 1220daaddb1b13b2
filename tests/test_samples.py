"""Counters made of events."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import samples

T0 = datetime(2024, 1, 1)


def events(spark, items):
    return spark.createDataFrame(
        [(k, T0 + timedelta(seconds=s), v) for k, s, v in items], "kind string, ts timestamp_ntz, value double")


def test_counter_restarts_each_day_and_sums_an_instant(spark):
    df = events(spark, [("a", 5, 1.0), ("a", 5, 1.0), ("a", 90, 1.0), ("a", 86399, 1.0), ("a", 86400, 1.0), (None, 7, 1.0)])
    found = samples.to_counter(df, {"kind": "kind"})
    rows = sorted((r.kind, (r.ts - T0).total_seconds(), r.value) for r in found.collect())
    assert rows == [("", 7.0, 1.0), ("a", 5.0, 2.0), ("a", 90.0, 3.0), ("a", 86399.0, 4.0), ("a", 86400.0, 1.0)]


@pytest.mark.parametrize("reset,expected", [(None, [1.0, 3.0, 6.0]), ("hour", [1.0, 2.0, 5.0])])
def test_counter_of_amounts(spark, reset, expected):
    df = events(spark, [("a", 3599, 1.0), ("a", 3600, 2.0), ("a", 3700, 3.0)])
    found = samples.to_counter(df, {"kind": "kind"}, amount=F.col("value"), reset=reset)
    assert [r.value for r in found.orderBy("ts").collect()] == expected


def test_scraped_counter(spark):
    df = events(spark, [("a", 1, 1.0), ("a", 29, 1.0), ("a", 31, 1.0)])
    found = samples.to_counter(df, {"kind": "kind"}, scrape="30s").orderBy("ts").collect()
    assert [((r.ts - T0).total_seconds(), r.value) for r in found] == [(0.0, 2.0), (30.0, 3.0)]


def test_bucket_counters_grow_along_the_bounds(spark):
    df = events(spark, [("a", 1, 5.0), ("a", 2, 50.0), ("a", 100, 5.0), ("a", 200, None)])
    found = samples.to_bucket_counters(df, {"kind": "kind"}, "value", [10, float("inf")])
    rows = sorted(((r.ts - T0).total_seconds(), r.le, r.value) for r in found.collect())
    inf = float("inf")
    assert rows == [(0.0, 10.0, 1.0), (0.0, inf, 2.0), (60.0, 10.0, 2.0), (60.0, inf, 3.0)]


def test_slices_must_fit_the_periods(spark):
    with pytest.raises(ValueError, match="hour"):
        samples.to_counter(events(spark, []), {"kind": "kind"}, slice_width="7m")
    with pytest.raises(ValueError, match="restart"):
        samples.to_counter(events(spark, []), {"kind": "kind"}, reset="fortnight")
