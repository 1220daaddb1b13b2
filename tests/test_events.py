"""Event analytics, joins, quantiles, neighbours and regression on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import events, joins, models, neighbours, prefix, quantiles


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantile_equals_numpy(spark, q):
    rng = np.random.default_rng(int(q * 100))
    groups = {"wide": rng.normal(0, 1e6, 500), "tied": rng.integers(-3, 3, 400) * 1.0,
              "one": np.array([4.25]), "tiny": rng.normal(0, 1e-9, 50), "same": np.full(300, -2.5)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    found = {r["g"]: (r["events"], r["quantile"]) for r in quantiles.exact_quantile(df, ["g"], "v", q).collect()}
    for name, values in groups.items():
        assert found[name][1] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-15)
    assert found["one"][0] == 2 and found["none"] == (1, None)


def test_quantile_with_null_group_and_without_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", float("inf"))], "g string, v double")
    found = {r["g"]: r["quantile"] for r in quantiles.exact_quantile(df, ["g"], "v", 0.5).collect()}
    assert found == {None: 2.0, "a": float("inf")}
    assert quantiles.exact_quantile(df, [], "v", 0.0).collect()[0]["quantile"] == 1.0


def test_sketch_is_near_the_exact_answer(spark):
    df = spark.range(20000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    near = events.latency_profile(df, ["g"], "v", exact=False).first()
    exact = events.latency_profile(df, ["g"], "v").first()
    assert near["events"] == exact["events"] and abs(near["p95"] - exact["p95"]) <= 4


def test_busiest_group_first(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0)], "g string, v double")
    assert [r["g"] for r in events.latency_profile(df, ["g"], "v").collect()] == ["b", "a"]


def test_success_rate_of_nothing(spark):
    empty = spark.createDataFrame([], "s string")
    assert events.success_rate(empty, [], F.col("s") == "ok").collect()[0]["success_rate"] is None


def test_label_cardinality_of_maps_and_columns(spark):
    df = spark.createDataFrame([({"a": str(i), "b": "x"},) for i in range(5)], "labels map<string,string>")
    flat = df.select(F.col("labels")["a"].alias("a"), F.col("labels")["b"].alias("b"))
    expected = [("a", 5, True), ("b", 1, False)]
    assert sorted(tuple(r) for r in events.label_cardinality(df, "labels", 4).collect()) == expected
    assert sorted(tuple(r) for r in events.label_cardinality(flat, ["a", "b"], 4).collect()) == expected
    near = events.label_cardinality(flat, ["a", "b"], 4, approximate=True)
    assert sorted(tuple(r) for r in near.collect()) == expected


def test_profile_counts_duplicates_and_surprises(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "z"), (3, None)], "id int, s string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    row = events.profile(df, ["id"], {"s": ["a"]}, "ts").first()
    assert (row["rows"], row["nulls_s"], row["unexpected_s"], row["duplicate_keys"]) == (4, 1, 1, 1)


def test_sequence_number_across_slices(spark):
    ids = list(range(0, 1000, 3))
    df = spark.createDataFrame([(i % 2, i) for i in ids], "g int, id long").repartition(5)
    rows = prefix.sequence_number(df, ["g"], "id", "n", slice_rows=10).collect()
    for g in (0, 1):
        ordered = sorted((r["id"], r["n"]) for r in rows if r["g"] == g)
        assert [n for _, n in ordered] == list(range(1, len(ordered) + 1))


def test_fact_dim_counts_repeated_dimension_rows(spark):
    facts = spark.createDataFrame([(1,), (1,), (2,), (9,)], "k int")
    dim = spark.createDataFrame([(1, "x"), (2, "y"), (2, "x")], "id int, c string")
    found = joins.fact_dim_topn(facts, dim, "k", "id", "c")
    assert [tuple(r) for r in found.collect()] == [("x", 3), ("y", 1)]
    assert joins.fact_dim_topn(facts, dim, "k", "id", "c", n=1).count() == 1


def test_missing_from_and_target_status(spark):
    tables = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    present = spark.createDataFrame([("a",), ("b",), ("b",)], "t string")
    keyed = spark.createDataFrame([("b",)], "t string")
    assert [r.t for r in joins.missing_from(tables, present, keyed, ["t"]).collect()] == ["a"]
    up = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("b", 1, 1.0)], "t string, ts int, value double")
    assert {r.t: r.status for r in joins.target_status(tables, up, ["t"]).collect()} == {
        "a": "down", "b": "up", "c": "missing"}


def vectors(spark, count, seed):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(count, 8)).astype("float32")
    return data, spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("block", [4096, 2])
def test_knn_equals_numpy(spark, block):
    data, table = vectors(spark, 120, 1)
    batch = table.filter("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = unit[:9].astype("float64") @ unit.T
    found = {}
    for row in neighbours.knn(table.repartition(6), batch, 4, block=block).collect():
        found.setdefault(row["query_id"], {})[row["rank"]] = row["vec_id"]
    for q in range(9):
        assert [found[q][r] for r in range(1, 5)] == list(np.argsort(-scores[q])[:4])


def test_knn_ties_go_to_the_smaller_id_and_zero_vectors_are_left_out(spark):
    table = spark.createDataFrame(
        [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (1, None), (2, [1.0])],
        "vec_id long, embedding array<float>")
    batch = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    found = neighbours.knn(table, batch, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [("q", 3), ("q", 5)]


def test_knn_of_empty_ragged_and_named_rows(spark):
    schema = "vec_id string, embedding array<double>"
    table = spark.createDataFrame(
        [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0]), ("e", None), ("f", [None, 1.0]),
         (None, [1.0, 0.0])], schema)
    queries = spark.createDataFrame(
        [(1, [2.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [])],
        "query_id int, embedding array<double>")
    found = neighbours.knn(table, queries, 2).orderBy("query_id", "rank")
    assert found.schema["vec_id"].dataType.simpleString() == "string"
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()] == [(1, "a", 1), (1, "b", 2)]
    assert neighbours.knn(table, queries.limit(0), 2).count() == 0
    assert neighbours.knn(table.limit(0), queries, 2).count() == 0


def test_ridge_leaves_incomplete_rows_out(spark):
    rows = [(i, float(i % 7), 3.0 * (i % 7) + 1.0) for i in range(100)]
    gaps = rows + [(200 + i, None, 1000.0) for i in range(20)] + [(300, 1.0, None)]
    schema = "id long, a double, y double"
    whole, part = (models.ridge(spark.createDataFrame(r, schema), ["a"], "y", 0.1, F.col("id") % 5 == 0).first()
                   for r in (rows, gaps))
    assert part["left_out"] == 21 and whole["left_out"] == 0
    assert part["intercept"] == pytest.approx(whole["intercept"]) and part["train_rows"] == whole["train_rows"]
    assert part["mse"] == pytest.approx(whole["mse"])


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 10, 0.1]
    y = x @ [2.0, -1.0, 5.0] + 4 + rng.normal(size=400)
    df = spark.createDataFrame(
        [(i, *map(float, x[i]), float(y[i])) for i in range(400)], "id long, a double, b double, c double, y double")
    row = models.ridge(df, ["a", "b", "c"], "y", 0.5, F.col("id") >= 300).first()
    train, mean = x[:300] - x[:300].mean(0), y[:300].mean()
    w = np.linalg.solve(train.T @ train + 0.5 * np.eye(3), train.T @ (y[:300] - mean))
    intercept = mean - x[:300].mean(0) @ w
    assert [row["coef_a"], row["coef_b"], row["coef_c"]] == pytest.approx(list(w), rel=1e-6)
    assert row["mse"] == pytest.approx(np.mean((y[300:] - intercept - x[300:] @ w) ** 2), rel=1e-6)
    assert (row["train_rows"], row["test_rows"]) == (300, 100)


def test_split_repeats(spark):
    df = spark.range(5000).withColumn("test", models.held_out(["id"]))
    first = {r["id"] for r in df.filter("test").collect()}
    assert first == {r["id"] for r in df.repartition(9).filter("test").collect()}
    assert 0.17 < len(first) / 5000 < 0.23


def test_run_metrics_best_step_is_the_first(spark):
    rows = [("r", "loss", s, v) for s, v in enumerate([3.0, 1.0, 2.0, 1.0, 1.5])]
    df = spark.createDataFrame(rows, "run_id string, key string, step long, value double")
    low = models.run_metrics(df).first()
    high = models.run_metrics(df, smaller_is_better=False).first()
    assert (low["last_value"], low["last_step"], low["best_value"], low["best_step"]) == (1.5, 4, 1.0, 1)
    assert (high["best_value"], high["best_step"], high["steps"]) == (3.0, 0, 5)


def test_quantile_of_a_narrow_band(spark):
    """Distinct epoch milliseconds are one slice; no part of it holds more than a few hundred."""
    n, base = 200_000, 1_706_000_000_000
    df = spark.range(n).select((F.col("id") * 7 + base).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    sizes = df.select(quantiles._value_slice(F.col("v")).alias("s"), quantiles._part(
        F.col("v"), F.lit(float(base)), F.lit(float(base + 7 * (n - 1)))).alias("p")).groupBy("s", "p").count()
    assert sizes.select("s").distinct().count() == 1
    assert sizes.agg(F.max("count")).first()[0] <= 200
    found = {r["g"]: r["quantile"] for r in quantiles.exact_quantile(df, ["g"], "v", 0.95).collect()}
    for g in (0, 1):
        values = np.arange(g, n, 2) * 7.0 + base
        assert found[g] == pytest.approx(np.quantile(values, 0.95), rel=1e-15)


def test_ridge_of_nan_and_constant_features(spark):
    nan = float("nan")
    given = [(i, float(i % 7), 3.0, 2.0 * (i % 7) + 1) for i in range(20)] + [(20, nan, 3.0, 1.0), (21, 1.0, 3.0, nan)]
    row = models.ridge(spark.createDataFrame(given, "id int, a double, c double, y double"), ["a", "c"], "y", 0.0, F.col("id") % 5 == 0).first()
    assert row["left_out"] == 2 and row["train_rows"] == 16 and row["mse"] == pytest.approx(0, abs=1e-18)
    assert row["coef_a"] == pytest.approx(2) and row["coef_c"] == 0 and row["intercept"] == pytest.approx(1)
