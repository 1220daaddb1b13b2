"""What the physical plans of the registered queries may and must not contain."""

import re

import pytest

from tallyloom import plans
from tallyloom.operators import ranges

plans.load_all()

# these start streams or write tables when they are built; their result is a plain read
_JOBS = {n for n, p in plans.QUERIES.items() if p.__module__.endswith(("streams", "table_jobs"))}
_LOG_REPORTS = {"latest_by_key", "consumer_lag", "group_lag", "order_check", "key_skew"}
_PLAIN = sorted((set(plans.QUERIES) - _JOBS - {"daily_rollup", "knn_cosine", "ridge_mse", "ridge_with_gaps"}) | _LOG_REPORTS)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", _PLAIN)
def test_no_cross_join_and_no_row_python(spark, sf_dir, name):
    plan = physical(plans.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", _PLAIN)
def test_windows_are_partitioned(spark, sf_dir, name):
    """A window without a partition would gather everything on one task."""
    for line in physical(plans.QUERIES[name](spark, sf_dir)).splitlines():
        if re.search(r"\bWindow \[", line):
            assert re.search(r"\)\) AS .*\], \[\w", line), line


@pytest.mark.parametrize("name,columns", [
    ("error_rate", "struct<ts:timestamp_ntz,event_type:string>"),
    ("fact_dim_topn_parts", "struct<l_partkey:bigint>"),
    ("latency_profile", "struct<event_type:string,value:double>"),
    ("status_counts", "struct<o_orderstatus:string>"),
])
def test_only_needed_columns_are_read(spark, sf_dir, name, columns):
    df = plans.QUERIES[name](spark, sf_dir)
    schemas = set(re.findall(r"ReadSchema: (struct<.*>)", physical(df).replace("...", "")))
    text = df._jdf.queryExecution().executedPlan().verboseStringWithOperatorId() if not schemas else ""
    assert columns in schemas or columns in text, schemas


@pytest.mark.parametrize("name,filters", [
    ("latency_profile_hourly", ["In(event_type", "GreaterThanOrEqual(ts,2024-01-24T00:00"]),
    ("recent_by_day", ["GreaterThanOrEqual(ts,2024-01-17T00:00"]),
    ("fact_dim_topn", ["GreaterThanOrEqual(o_orderdate"]),
    ("recent_finished", ["EqualTo(o_orderstatus,F)"]),
    ("instant_at", ["GreaterThanOrEqual(ts,2024-01-15T06:00", "LessThan(ts,2024-01-15T12:00"]),
])
def test_filters_reach_the_scan(spark, sf_dir, name, filters):
    plan = physical(plans.QUERIES[name](spark, sf_dir))
    for text in filters:
        assert text in plan


def test_top_n_is_not_a_full_sort(spark, sf_dir):
    for name in ("fact_dim_topn", "recent_finished"):
        assert "TakeOrderedAndProject" in physical(plans.QUERIES[name](spark, sf_dir))


def test_counters_read_their_events_once(spark, sf_dir):
    df = plans.QUERIES["error_rate"](spark, sf_dir)
    df.collect()
    final = physical(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize("name", ["vector_ratio", "vector_sum", "utilisation", "histogram_mean", "panel_latency"])
def test_parts_of_a_vector_share_one_pipeline(spark, sf_dir, name):
    """The range function runs once: its instants are gathered by one Generate of evaluation times."""
    plan = physical(plans.QUERIES[name](spark, sf_dir)).split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Generate explode\(.*sequence", plan)) <= 1
    # a counter reads its instants and their slice totals from one scan or an exchange that is reused
    assert plan.count("FileScan") <= 2


def test_range_reaches_the_events(spark, sf_dir):
    plan = physical(plans.QUERIES["range_query"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-30T00:00" in plan and "LessThan(ts,2024-01-30T18:00" in plan


_RATES = ["error_rate", "counter_rate", "rate_5m", "rate_skewed_series", "increase_repeated_samples", "instant_lookup",
          "vector_ratio", "histogram_quantile"]


@pytest.mark.parametrize("name", _RATES)
def test_no_series_is_one_task(spark, sf_dir, name):
    """Windows over samples, slices and buckets of a series are cut by a slice, a block or a period."""
    plan = physical(plans.QUERIES[name](spark, sf_dir)).split("== Initial Plan ==")[-1]
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            # the partition is the last list but one: Window [functions], [partition], [order]
            partition = re.findall(r"\[([^\[\]]*)\]", line)[-2]
            assert re.search(r"_slice|_span|_restart|step", partition), line


@pytest.mark.parametrize("name", ["error_rate", "counter_rate", "rate_5m"])
def test_rates_shuffle_samples_once(spark, sf_dir, name):
    """Counters made of events lie by minute already, and the range function leaves them there."""
    df = plans.QUERIES[name](spark, sf_dir)
    df.collect()
    final = physical(df).split("== Initial Plan ==")[0]
    exchanges = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert len(exchanges) <= 5, exchanges


def test_stored_samples_are_shuffled_once(spark, folder):
    """Exchanges of a rate over stored samples: one of samples, one of slices."""
    path = folder("samples")
    spark.range(1000).selectExpr("'a' AS job", "timestamp_seconds(id * 7) AS ts", "CAST(id AS DOUBLE) AS value").write.parquet(path)
    plan = physical(ranges.rate(spark.read.parquet(path), ["job"], "5m", "1m")).split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2
