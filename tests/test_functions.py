"""Matchers, display text, payloads, names and ids."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import display, labels, records, timeaxis


@pytest.mark.parametrize("text,expected", [("30s", 30), ("5m", 300), ("6h", 21600), ("1 hour", 3600),
                                           ("5 minutes", 300), ("2d", 172800), (15, 15)])
def test_durations(text, expected):
    assert timeaxis.seconds(text) == expected


@pytest.mark.parametrize("text", ["", "m", "0s", "5 fortnights", "1 month", -3])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        timeaxis.seconds(text)


PODS = ["trino-coordinator-0", "trino-worker-1", "trino-x", "kafka", "kafka-main-0", "strimzi", "akafka", "", None]


@pytest.mark.parametrize("matcher,expected", [
    (("pod", "=~", "trino-(coordinator|worker).*"), ["trino-coordinator-0", "trino-worker-1"]),
    (("pod", "=~", "kafka.*|strimzi.*"), ["kafka", "kafka-main-0", "strimzi"]),
    (("pod", "=~", "kafka"), ["kafka"]),
    (("pod", "=~", ".+"), [p for p in PODS if p]),
    (("pod", "=~", ".*"), PODS),
    (("pod", "!~", "kafka.*"), [p for p in PODS if not (p or "").startswith("kafka")]),
    (("pod", "!=", ""), [p for p in PODS if p]),
    (("pod", "!=", "kafka"), [p for p in PODS if p != "kafka"]),
    (("pod", "=", ""), ["", None]),
    (("pod", "=", "kafka"), ["kafka"]),
    (("pod", "=~", "a?kafka"), ["akafka", "kafka"]),
])
def test_matchers(spark, matcher, expected):
    df = spark.createDataFrame([(p,) for p in PODS], "pod string")
    found = [r.pod for r in labels.select_series(df, [matcher]).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


@settings(max_examples=200, deadline=None)
@given(st.text("ab-|().*?+", max_size=8), st.text("ab-", max_size=5))
def test_prefixes_never_lose_a_match(pattern, text):
    try:
        whole = re.compile(f"(?:{pattern})")
    except re.error:
        return
    prefixes = labels._literal_prefixes(pattern)
    if prefixes and whole.fullmatch(text):
        assert any(text.startswith(p) for p in prefixes)


def test_equality_and_prefix_reach_the_scan(spark, folder):
    path = folder("pods")
    spark.createDataFrame([(p,) for p in PODS], "pod string").write.parquet(path)
    df = spark.read.parquet(path)
    plan = lambda m: labels.select_series(df, [m])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(pod,kafka)" in plan(("pod", "=", "kafka"))
    assert "StringStartsWith(pod,kafka)" in plan(("pod", "=~", "kafka.*"))


def test_promote_labels(spark):
    df = spark.createDataFrame([({"pod": "a"}, 1.0)], "labels map<string,string>, value double")
    assert labels.promote_labels(df, ["pod", "job"]).first().asDict() == {"value": 1.0, "pod": "a", "job": ""}


def test_legend(spark):
    df = spark.createDataFrame([("a", None)], "pod string, path string")
    assert df.select(display.legend("{{pod}}/{{ path }} in")).first()[0] == "a/ in"


def test_threshold_states(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.99, 1.0, 3.0, None)], "v double")
    steps = [(None, "green"), (1, "yellow"), (3, "red")]
    assert [r[0] for r in df.select(display.threshold_state("v", steps)).collect()] == [
        "green", "green", "yellow", "red", None]


@pytest.mark.parametrize("unit,value,text", [
    ("bytes", 1536.0, "1.50 KiB"), ("bytes", 5.0, "5.00 B"), ("bytes", 3 * 2.0**30, "3.00 GiB"),
    ("Bps", 2500.0, "2.50 kB/s"), ("percent", 12.345, "12.35%"), ("percentunit", 0.5, "50.00%"),
    ("s", 90.0, "1.50 min"), ("s", 0.25, "250.00 ms"), ("ms", 1500.0, "1.50 s"),
    ("ops", 1200.0, "1.20 K ops/s"), ("short", -2e6, "-2.00 Mil"), ("none", 7.0, "7.00"),
])
def test_units(spark, unit, value, text):
    assert spark.range(1).select(display.format_unit(F.lit(value), unit)).first()[0] == text


def test_typed_props_ignores_and_defaults(spark):
    df = spark.createDataFrame([(1, '{"k": 3, "new": true}'), (2, "{}")], "id int, props string")
    rows = records.typed_props(df, "k int, source string", defaults={"source": "web"}).collect()
    assert [tuple(r) for r in rows] == [(1, 3, "web"), (2, None, "web")]


def test_relabel_first_rule_wins(spark):
    rules = [
        (r"app\.server<type=Metrics, name=(In|Out)><>Count", "app_$1_total", "COUNTER"),
        (r"app\.server<.*", "app_other", "GAUGE"),
    ]
    names = ["app.server<type=Metrics, name=In><>Count", "app.server<x>", "unknown"]
    df = spark.createDataFrame([(n,) for n in names], "source_name string")
    assert [(r.metric, r.kind) for r in records.relabel(df, rules).collect()] == [
        ("app_in_total", "counter"), ("app_other", "gauge")]


def test_stable_id_is_the_hash_of_the_joined_texts(spark):
    df = spark.createDataFrame([(7, "x", None)], "a int, b string, c string")
    expected = hashlib.sha256("|".join(str(v) for v in (7, "x", None)).encode()).hexdigest()[:16]
    assert df.select(records.stable_id(["a", "b", "c"])).first()[0] == expected
