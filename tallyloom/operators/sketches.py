"""Sketches kept per period and merged for any range of periods; raw rows are read once.

States are ordinary rows with a binary column: write them with ``tables.overwrite_partitions``
by ``day``, and a day that is computed again replaces its states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import label
from ..functions.timeaxis import calendar, is_ntz

#: Size of a quantile sketch: ranks are off by about 0.15 % of the rows, whatever is merged.
KLL_SIZE = 2000
#: Size of a distinct sketch as a power of two: exact below it, about 1.6 % off beyond.
LG_SIZE = 12


def _between(states: DataFrame, column: str, since: str | None, until: str | None) -> DataFrame:
    kind = states.schema[column].dataType
    if since is not None:
        states = states.filter(F.col(column) >= F.lit(since).cast(kind))
    return states if until is None else states.filter(F.col(column) < F.lit(until).cast(kind))


def quantile_states(
    df: DataFrame, by: Sequence[str], measure: str, grain: str = "hour", ts: str = "ts", size: int = KLL_SIZE,
) -> DataFrame:
    """``day``, ``bucket``, the groups, ``events`` and the sketch of a measure; nulls and NaN count as events only."""
    value = F.col(measure).cast("double")
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(F.to_date(ts).alias("day"), calendar(ts, grain, is_ntz(df, ts)).alias("bucket"), *by)
        .agg(F.count(F.lit(1)).alias("events"),
             F.kll_sketch_agg_double(F.when(~F.isnan(value), value), F.lit(size)).alias("sketch"))
    )


def quantiles(
    states: DataFrame, by: Sequence[str], q: float | Sequence[float], since: str | None = None, until: str | None = None,
    size: int = KLL_SIZE,
) -> DataFrame:
    """Per group ``events`` and ``quantiles`` at the ranks ``q``, from the states of ``[since, until)``.

    ``by`` may be fewer columns than the states have. A group without values has null.
    """
    ranks = F.array(*[F.lit(float(r)) for r in ([q] if isinstance(q, (int, float)) else q)])
    merged = (
        _between(states, "bucket", since, until).groupBy(*by)
        .agg(F.sum("events").alias("events"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("_sketch"))
    )
    filled = F.kll_sketch_get_n_double("_sketch") > 0
    return merged.select(*by, "events", F.when(filled, F.kll_sketch_get_quantile_double("_sketch", ranks)).alias("quantiles"))


def label_states(samples: DataFrame, labels: Sequence[str], ts: str = "ts", lg_size: int = LG_SIZE) -> DataFrame:
    """``day``, ``label`` and two sketches of its values: ``counted``, small, and ``seen``, which can be subtracted.

    A sample counts once for each of its labels; an empty or missing label is no value. Each
    task reduces its samples to sketches, and only these are shuffled.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), label(n).alias("value")) for n in labels]))
    return (
        samples.filter(F.col(ts).isNotNull())
        .select(F.to_date(ts).alias("day"), pairs.alias("_p")).select("day", "_p.*").filter("value <> ''")
        .groupBy("day", "label")
        .agg(F.hll_sketch_agg("value", F.lit(lg_size)).alias("counted"), F.theta_sketch_agg("value", F.lit(lg_size)).alias("seen"))
    )


def cardinality(states: DataFrame, since: str | None = None, until: str | None = None, limit: int = 100) -> DataFrame:
    """Distinct values per label over the days ``[since, until)``, and whether they exceed the limit."""
    return (
        _between(states, "day", since, until).groupBy("label")
        .agg(F.hll_sketch_estimate(F.hll_union_agg("counted")).alias("distinct_values"))
        .withColumn("unbounded", F.col("distinct_values") > limit)
    )


def _estimate(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def new_values(states: DataFrame, since: str | None = None, until: str | None = None, lg_size: int = LG_SIZE) -> DataFrame:
    """Per label and day of ``[since, until)``: distinct values, those no earlier day had, and all so far.

    Earlier days are all days of the states, also those before ``since``.
    """
    earlier = Window.partitionBy("label").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    known = states.withColumn("_before", F.theta_union_agg("seen", F.lit(lg_size)).over(earlier))
    # the first day has an empty sketch before it, or none
    fresh = F.when(F.col("_before").isNull(), _estimate(F.col("seen"))).otherwise(
        _estimate(F.theta_difference("seen", "_before")))
    so_far = F.when(F.col("_before").isNull(), _estimate(F.col("seen"))).otherwise(
        _estimate(F.theta_union("seen", "_before", F.lit(lg_size))))
    return _between(known, "day", since, until).select(
        "label", "day", _estimate(F.col("seen")).alias("distinct_values"), fresh.alias("new_values"), so_far.alias("values_so_far"))
