"""Vector algebra, histograms and panels."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyloom.operators import histogram, panels, ranges, vectors

T0 = datetime(2024, 1, 1)
SCHEMA = "job string, step timestamp_ntz, value double"


def vector(spark, rows):
    return spark.createDataFrame([(j, T0 + timedelta(minutes=m), v) for j, m, v in rows], SCHEMA)


def values(df):
    return sorted(tuple(r) for r in df.drop("step").collect())


def test_unmatched_series_drop(spark):
    a, b = vector(spark, [("x", 0, 1.0), ("y", 0, 2.0)]), vector(spark, [("x", 0, 3.0), ("z", 0, 4.0)])
    assert values(vectors.vector_op(a, b, "+")) == [("x", 4.0)]
    assert values(vectors.vector_op(a, b, "-")) == [("x", -2.0)]
    assert values(vectors.vector_op(a, b, "*")) == [("x", 3.0)]


def test_zero_denominator_is_null_and_floor_guards(spark):
    a, b = vector(spark, [("x", 0, 1.0)]), vector(spark, [("x", 0, 0.0)])
    assert values(vectors.vector_op(a, b, "/")) == [("x", None)]
    assert values(vectors.ratio(a.drop("job"), b.drop("job"), floor=0.001)) == [(1000.0,)]


def test_share_equals_the_join(spark):
    rows = [("e", 0, 1.0), ("o", 0, 3.0), ("o", 1, 5.0), ("e", 2, 0.0), ("o", 2, 0.0)]
    v = vector(spark, rows)
    joined = vectors.ratio(vectors.agg(v.filter("job = 'e'"), "sum"), vectors.agg(v, "sum"), 0.001)
    single = vectors.share(v, F.col("job") == "e", floor=0.001)
    assert values(single) == values(joined) == [(0.0,), (0.25,)]


def test_topk_breaks_ties_by_label(spark):
    v = vector(spark, [("c", 0, 5.0), ("a", 0, 5.0), ("b", 0, 5.0), ("d", 0, 9.0), ("a", 1, 1.0)])
    assert values(vectors.topk(2, v)) == [("a", 1.0), ("a", 5.0), ("d", 9.0)]
    assert values(vectors.topk(1, v, by_step=False)) == [("d", 9.0)]


def test_topk_keeps_k_rows_before_the_shuffle(spark):
    v = vector(spark, [("a", 0, 1.0)])
    assert "WindowGroupLimit" in vectors.topk(2, v)._jdf.queryExecution().executedPlan().toString()


def test_aggregates(spark):
    v = vector(spark, [("a", 0, 1.0), ("b", 0, 3.0)])
    found = {how: values(vectors.agg(v, how)) for how in ("sum", "max", "min", "avg", "count")}
    assert found == {"sum": [(4.0,)], "max": [(3.0,)], "min": [(1.0,)], "avg": [(2.0,)], "count": [(2.0,)]}


def quantile(spark, q, buckets):
    df = spark.createDataFrame(buckets, "job string, le double, value double")
    return [r["value"] for r in histogram.histogram_quantile(q, df, ["job"]).orderBy("job").collect()]


INF = float("inf")


def test_quantile_interpolates(spark):
    assert quantile(spark, 0.5, [("a", 1.0, 0.0), ("a", 2.0, 10.0), ("a", INF, 10.0)]) == [1.5]
    assert quantile(spark, 0.25, [("a", 8.0, 4.0), ("a", INF, 4.0)]) == [2.0]


def test_quantile_edges(spark):
    assert quantile(spark, 0.9, [("a", 1.0, 0.0), ("a", INF, 0.0)]) == [None]
    assert quantile(spark, 0.9, [("a", 1.0, 0.0), ("a", 5.0, 0.0), ("a", INF, 7.0)]) == [5.0]
    assert quantile(spark, 0.9, [("a", 1.0, 3.0), ("a", 5.0, 4.0)]) == [None]


def test_quantile_sums_repeated_buckets_and_repairs_dips(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", INF, 8.0)]
    assert quantile(spark, 0.5, rows) == [1.0]


def test_panel_is_the_union_of_its_targets(spark):
    rows = [(job, T0 + timedelta(seconds=s), float(s // 7 * (1 + len(job))))
            for job in ("x", "yy", "") for s in range(0, 900, 20)]
    samples = spark.createDataFrame(rows, "job string, ts timestamp_ntz, value double")
    shown = panels.panel(samples, ["job"], [
        panels.Target("{{job}} now", [("job", "!=", "")], "instant", "5m", None),
        panels.Target("per minute", [], "rate", "5m", "sum", scale=60),
        panels.Target("x only", [("job", "=", "x")], "rate", "5m", "max"),
    ])
    rates = ranges.rate(samples, ["job"])
    expected = (
        ranges.instant(samples.filter("job <> ''"), ["job"]).select(
            F.concat("job", F.lit(" now")).alias("legend"), "step", "value")
        .unionByName(vectors.agg(rates, "sum").select(
            F.lit("per minute").alias("legend"), "step", (F.col("value") * 60).alias("value")))
        .unionByName(rates.filter("job = 'x'").select(F.lit("x only").alias("legend"), "step", "value"))
    )
    key = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.select("legend", "step", "value").collect())
    assert key(shown) == key(expected)


def test_panel_aggregates_and_labels_of_their_own(spark):
    rows = [(a, b, T0, v) for a, b, v in (("x", "p", 1.0), ("x", "q", 5.0), ("y", "p", 9.0))]
    samples = spark.createDataFrame(rows, "a string, b string, ts timestamp_ntz, value double")
    hows = {how: panels.Target(how + " {{a}}", [("b", "=~", "p|q")], how=how, by=["a"])
            for how in ("sum", "avg", "max", "min", "count")}
    shown = panels.panel(samples, ["a", "b"], [*hows.values(), panels.Target("by b", by=["b"])], "5m")
    found = {}
    for r in shown.collect():
        found.setdefault(r["legend"], []).append(r["value"])
    assert found == {
        "sum x": [6.0], "sum y": [9.0], "avg x": [3.0], "avg y": [9.0], "max x": [5.0], "max y": [9.0],
        "min x": [1.0], "min y": [9.0], "count x": [2.0], "count y": [1.0], "by b": found["by b"]}
    assert sorted(found["by b"]) == [5.0, 10.0]


def test_panel_of_one_pass_scans_once(spark, folder):
    path = folder("samples")
    rows = [("x", "p", T0, 1.0)]
    spark.createDataFrame(rows, "a string, b string, ts timestamp_ntz, value double").write.parquet(path)
    shown = panels.panel(spark.read.parquet(path), ["a", "b"], [
        panels.Target("{{a}}", by=["a"]), panels.Target("{{b}}", by=["b"]), panels.Target("all", how="max")], "5m")
    assert shown._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_reducers_skip_nulls_for_last(spark):
    rows = [("l", T0, 1.0), ("l", T0 + timedelta(minutes=1), 4.0), ("l", T0 + timedelta(minutes=2), None)]
    df = spark.createDataFrame(rows, "legend string, step timestamp_ntz, value double")
    assert panels.reduce_series(df).first().asDict() == {"legend": "l", "last": 4.0, "mean": 2.5, "max": 4.0}
