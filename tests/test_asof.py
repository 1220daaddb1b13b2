"""The as-of join against a search through all rows."""

import random
from datetime import datetime, timedelta

import pytest

from tallyloom.operators import asof

T0 = datetime(2024, 1, 1)
LEFT, RIGHT = "key string, at timestamp_ntz, id int", "key string, ts timestamp_ntz, n int, v string"


def when(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def frames(spark, left, right):
    return (spark.createDataFrame([(k, when(t), i) for k, t, i in left], LEFT),
            spark.createDataFrame([(k, when(t), n, v) for k, t, n, v in right], RIGHT))


def brute(left, right, within=None, strict=False, how="left"):
    out = []
    for key, at, i in left:
        found = [(t, n, v) for k, t, n, v in right if k is not None and k == key and t is not None and at is not None
                 and (t < at or t == at and not strict)]
        best = max(found, key=lambda f: (f[0], f[1], f[2] is not None, f[2] or ""), default=None)
        if best and within is not None and best[0] < at - within:
            best = None
        if best or how == "left":
            out.append((key, when(at), i, *((when(best[0]), *best[1:]) if best else (None, None, None))))
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["key", "at", "id", "ts", "n", "v"]
    return sorted((tuple(r) for r in df.collect()), key=str)


random.seed(4)
KEYS = ["a"] * 6 + ["b", "c", None]
LEFT_ROWS = [(random.choice(KEYS), random.choice([None, *range(0, 40_000, 450)]), i) for i in range(250)]
RIGHT_ROWS = [(random.choice(KEYS), random.choice([None, *range(0, 40_000, 900)]), random.randrange(3), random.choice(["x", "y", None]))
              for _ in range(120)]


@pytest.mark.parametrize("options", [
    {}, {"strict": True}, {"how": "inner"}, {"within": 1800}, {"within": 900, "strict": True, "how": "inner"}])
@pytest.mark.parametrize("width", ["10m", "1h", "1d"])
def test_asof_join_of_ties_gaps_and_nulls(spark, options, width):
    left, right = frames(spark, LEFT_ROWS, RIGHT_ROWS)
    assert result(asof.asof_join(left, right, ["key"], "at", "ts", width=width, **options)) == brute(LEFT_ROWS, RIGHT_ROWS, **options)


def test_asof_join_repeats_and_empty_sides(spark):
    rows = [("a", 10, 1), ("a", 10, 1), ("b", 5, 2)]
    left, right = frames(spark, rows, [("a", 3, 1, "x"), ("a", 3, 1, "x")])
    assert result(asof.asof_join(left, right, ["key"], "at", "ts")) == brute(rows, [("a", 3, 1, "x")])
    assert result(asof.asof_join(left, right.limit(0), ["key"], "at", "ts")) == brute(rows, [])
    assert result(asof.asof_join(left.limit(0), right, ["key"], "at", "ts")) == []


def test_asof_join_before_1970_and_far_ahead(spark):
    rows, facts = [("a", -3_000_000_000, 1), ("a", 3_000_000_000, 2)], [("a", -3_000_000_001, 7, None)]
    left, right = frames(spark, rows, facts)
    assert result(asof.asof_join(left, right, ["key"], "at", "ts")) == brute(rows, facts)


def test_asof_join_refuses_what_it_cannot_name(spark):
    left, right = frames(spark, [], [])
    with pytest.raises(ValueError, match="both sides have id"):
        asof.asof_join(left, right.withColumnRenamed("n", "id"), ["key"], "at", "ts")
    with pytest.raises(ValueError, match="outer"):
        asof.asof_join(left, right, ["key"], "at", "ts", how="outer")


def test_a_hot_key_is_many_tasks(spark):
    """No window is partitioned by the key alone but the one over slices, and sides are never joined by key."""
    left, right = frames(spark, LEFT_ROWS, RIGHT_ROWS)
    plan = asof.asof_join(left, right, ["key"], "at", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 2 and plan.count("hashpartitioning(_slice") == 1
