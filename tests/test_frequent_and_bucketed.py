"""Heavy keys against counts, bucketed upserts against plain ones, sketches and variants."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import records
from tallyloom.operators import frequent, sketches
from tallyloom.session import scratch_path
from tallyloom.sources import bucketed, files, tables


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("share", [0.3, 0.02, 0.004, 1.0])
def test_heavy_keys_are_all_found_and_counted(spark, share):
    random.seed(share)
    keys = [None] * 3000 + ["hot"] * 2500 + [f"w{i % 40}" for i in range(3200)] + [f"cold{i}" for i in range(4000)] + [""] * 60
    random.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7)
    counts = pd.Series(["<null>" if k is None else k for k in keys]).value_counts()
    expected = {k: int(n) for k, n in counts.items() if n >= share * len(keys)}
    found = {("<null>" if r["key"] is None else r["key"]): r["records"] for r in frequent.heavy_keys(df, share).collect()}
    assert found == expected


def test_heavy_keys_shuffle_no_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("key"))
    plan = physical(frequent.heavy_keys(df, 0.2))
    assert "SortMergeJoin" not in plan and plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    assert frequent.heavy_keys(df.limit(0), 0.2).count() == 0
    with pytest.raises(ValueError):
        frequent.heavy_keys(df, 0)


def test_summaries_stay_small_and_near():
    counts = pd.Series(range(1, 101), index=[f"k{i}" for i in range(100)])
    low = frequent._lowered(counts, 10)
    assert len(low) == 10 and (counts[low.index] - low).max() <= counts.sum() / 11


@pytest.fixture()
def table(spark):
    name = "bucketed_under_test"
    base = spark.createDataFrame([(i, i % 5, f"v{i}") for i in range(200)] + [(None, 1, "none")], "id int, t int, s string")
    bucketed.write_bucketed(base, name, scratch_path(spark, "bucketed"), ["id"], 16)
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


CHANGES = [(3, 9, "later"), (4, -1, "stale"), (4, 9, "B"), (4, 9, "A"), (7, 2, "tie, larger"), (500, 1, "new"), (501, None, "no time")]


def test_bucketed_upsert_equals_a_plain_one_and_leaves_the_base(spark, table):
    changes = spark.createDataFrame(CHANGES, "id int, t int, s string")
    found = bucketed.upsert_bucketed(spark, table, changes, ["id"], ["t"])
    plain = tables.upsert(spark.table(table), changes, ["id"], ["t"])
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(found) == key(plain)
    plan = physical(found).split("== Initial Plan ==")[-1]
    base, fresh = plan[plan.index("SortMergeJoin"):].split(":  ", 1)[0], plan
    assert "Bucketed: true" in fresh and plan.count("Exchange") == 2 and not base.count("Exchange")
    # twice is once, also after the table was replaced
    bucketed.replace_bucketed(spark, found, table, scratch_path(spark, "bucketed"), ["id"], 16)
    again = bucketed.upsert_bucketed(spark, table, changes, ["id"], ["t"])
    assert key(again) == key(plain) and "Bucketed: true" in physical(again)


def test_bucketed_tables_are_joined_where_they_lie(spark, table):
    other = "bucketed_other"
    bucketed.write_bucketed(spark.range(50).select(F.col("id").cast("int").alias("id"), F.lit(1).alias("n")), other,
                            scratch_path(spark, "bucketed"), ["id"], 16)
    joined = bucketed.join_bucketed(spark, table, other, ["id"])
    assert joined.count() == 50 and "Exchange" not in physical(joined)
    spark.sql(f"DROP TABLE {other}")


def test_sketches_answer_ranges_without_raw_rows(spark, folder):
    raw, stored = folder("raw"), folder("states")
    spark.range(50_000).select(
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).cast("string").alias("k"),
        F.when(F.col("id") % 100 == 0, None).when(F.col("id") % 100 == 1, float("nan")).otherwise((F.col("id") * 7919 % 50_000).cast("double")).alias("v"),
        F.col("id").cast("string").alias("user")).write.parquet(raw)
    events = spark.read.parquet(raw)
    tables.overwrite_partitions(sketches.quantile_states(events, ["k"], "v"), stored, "day")
    exact = {k: sorted(r["v"] for r in events.filter(f"k = '{k}' AND v IS NOT NULL AND NOT isnan(v)").collect()) for k in "012"}
    files.remove(spark, raw)
    states = spark.read.parquet(stored)
    for r in sketches.quantiles(states, ["k"], [0.0, 0.5, 0.95, 1.0]).collect():
        values = exact[r["k"]]
        for q, guess in zip([0.0, 0.5, 0.95, 1.0], r["quantiles"], strict=True):
            assert abs(sum(v <= guess for v in values) / len(values) - q) < 0.01
    whole = sketches.quantiles(states, [], 0.5).first()
    assert whole["events"] == 50_000 and abs(whole["quantiles"][0] - 25_000) < 500
    day = sketches.quantiles(states, ["k"], 0.5, "1970-01-02 00:00:00", "1970-01-03 00:00:00")
    assert sum(r["events"] for r in day.collect()) == 1440


def test_sketches_of_no_values(spark):
    rows = spark.createDataFrame([("a", None)], "k string, v double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    row, = sketches.quantiles(sketches.quantile_states(rows, ["k"], "v"), ["k"], 0.5).collect()
    assert (row["events"], row["quantiles"]) == (1, None)


def test_new_label_values_by_day(spark):
    rows = [(1, "a"), (1, "b"), (2, "b"), (2, ""), (2, None), (4, "a"), (4, "c"), (4, "d")]
    samples = spark.createDataFrame([(f"2024-01-0{d} 12:00:00", v) for d, v in rows], "t string, pod string").withColumn(
        "ts", F.col("t").cast("timestamp_ntz"))
    states = sketches.label_states(samples, ["pod"])
    found = [tuple(r)[1:] for r in sketches.new_values(states).orderBy("day").collect()]
    assert [(str(d), *rest) for d, *rest in found] == [("2024-01-01", 2, 2, 2), ("2024-01-02", 1, 0, 2), ("2024-01-04", 3, 2, 4)]
    assert sketches.new_values(states, since="2024-01-04").first()["new_values"] == 2
    assert sketches.cardinality(states, limit=3).first()[1:] == (4, True)


def test_variants_of_any_shape(spark):
    payloads = ['{"k": 1}', '{"k": "2"}', '{"k": {"deep": 3}}', '{"k": null}', '{}', "[1]", "nothing", None, '{"k": 1e400}', '{"k": 2.0}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, props string")
    found = records.variant_props(df, {"k": ("$.k", "int"), "deep": ("$.k.deep", "int")}).orderBy("id").collect()
    assert [r["k"] for r in found] == [1, 2, None, None, None, None, None, None, None, 2]
    assert [r["deep"] for r in found] == [None, None, 3] + [None] * 7
    row, = records.payload_drift(df.filter("id < 8"), []).collect()
    assert (row["records"], row["unreadable"], row["payload_type"]) == (8, 1, "VARIANT")
