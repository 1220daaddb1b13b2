"""Event-table analytics: profiles, rates, cardinality, rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import label
from .quantiles import exact_quantile


def latency_profile(
    df: DataFrame, by: Sequence[str], measure: str = "duration_ms", q: float = 0.95,
    out: str = "p95", exact: bool = True,
) -> DataFrame:
    """Row count and quantile of a measure per group, busiest first.

    ``exact=False`` uses the built-in sketch: one pass, bounded memory, and a rank
    error of at most 1/10000 of the group.
    """
    if exact:
        result = exact_quantile(df, by, measure, q, "events", out)
    else:
        result = df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("events"),
            F.percentile_approx(measure, float(q), 10_000).alias(out),
        )
    return result.orderBy(F.col("events").desc(), *by)


def success_rate(df: DataFrame, by: Sequence[str], ok: Column) -> DataFrame:
    """Share of rows that are ``ok``; an empty group gives null instead of an error."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.try_divide(
            F.sum(F.when(ok, 1).otherwise(0)), F.nullif(F.count(F.lit(1)), F.lit(0))
        ).alias("success_rate"),
    )


def label_cardinality(
    samples: DataFrame, labels: Sequence[str] | str, limit: int = 100, approximate: bool = False
) -> DataFrame:
    """Distinct values per label and whether they exceed the limit.

    ``labels`` is a list of label columns or the name of a label map. Each task reduces
    its samples to distinct (label, value) pairs, and only these are shuffled: one label
    without bound does not make the others travel with it.
    """
    if isinstance(labels, str):
        pairs = samples.select(F.explode(labels).alias("label", "label_value"))
    else:
        series = samples.select(*[label(n).alias(n) for n in labels])
        pairs = series.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("label"), F.col(n).alias("label_value")) for n in labels
        ])).alias("_p")).select("_p.*").filter("label_value <> ''")
    if approximate:
        counted = pairs.groupBy("label").agg(
            F.approx_count_distinct("label_value").alias("distinct_values"))
    else:
        counted = pairs.distinct().groupBy("label").agg(
            F.count(F.lit(1)).alias("distinct_values"))
    return counted.withColumn("unbounded", F.col("distinct_values") > limit)


def freshness(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def profile(
    df: DataFrame, keys: Sequence[str], enums: Mapping[str, Sequence[str]], ts: str
) -> DataFrame:
    """One row: rows, nulls per column, unexpected enum values, duplicate keys, freshness.

    Everything is folded per key first and then over the keys: one scan, and a
    shuffle of one partial row per key. Copies of a key meet before the shuffle.
    """
    sums = {"rows": F.count(F.lit(1))}
    for column in df.columns:
        sums[f"nulls_{column}"] = F.count_if(F.col(column).isNull())
    for column, allowed in enums.items():
        sums[f"unexpected_{column}"] = F.count_if(
            F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)))
    per_key = df.groupBy(*keys).agg(
        *[s.alias(n) for n, s in sums.items()], F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
    return per_key.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums],
        F.count_if(F.col("rows") > 1).alias("duplicate_keys"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
