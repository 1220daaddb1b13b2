"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Slices per doubling of the measure, and an offset beyond any double's exponent in slices.
_PER_OCTAVE = 1024
_OFFSET = 1 << 21
# A slice that holds a rank is cut into so many equal parts.
_PARTS = 1024


def _value_slice(value: Column) -> Column:
    """A slice number that never decreases with the value; about 0.07% wide."""
    def height(magnitude: Column) -> Column:
        capped = F.least(F.log2(magnitude), F.lit(1100.0))
        return F.floor(capped * _PER_OCTAVE) + _OFFSET

    return (
        F.when(value > 0, height(value))
        .when(value < 0, -height(-value))
        .when(value == 0, F.lit(0).cast("long"))
    )


def _part(value: Column, low: Column, high: Column) -> Column:
    """Which of ``_PARTS`` equal parts of ``[low, high]`` the value lies in."""
    return F.when(high > low, F.floor((value - low) / (high - low) * (_PARTS - 1))).otherwise(F.lit(0)).cast("long")


def exact_quantile(
    df: DataFrame, by: Sequence[str], measure: str, q: float,
    count: str = "events", out: str = "quantile",
) -> DataFrame:
    """Row count and interpolated quantile of ``measure`` per ``by``.

    Equal values are counted before the shuffle. The ranks wanted are located on
    per-slice counts, then the one or two slices that hold them are cut into ``_PARTS``
    equal parts between their smallest and largest value and the ranks located again.
    Only the parts that hold a rank are sorted: also where all values lie in one narrow
    band, a task sorts about a thousandth of a group's distinct values, unless these
    crowd together once more. Nulls and NaN count as rows, not as values.
    """
    keys = list(by)
    value = F.col(measure).cast("double")
    counts = (
        df.select(*keys, F.when(~F.isnan(value), value).alias("_value"))
        .groupBy(*keys, "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_slice", _value_slice(F.col("_value")))
    )
    # nulls sort first, so the slice without a value never shifts a rank
    totals = counts.groupBy(*keys, "_slice").agg(
        F.sum("_n").alias("_m"), F.min("_value").alias("_min"), F.max("_value").alias("_max"))
    known = F.when(F.col("_slice").isNotNull(), F.col("_m")).otherwise(0)
    along = Window.partitionBy(*keys).orderBy("_slice")
    whole = Window.partitionBy(*keys)
    before = F.sum(known).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rank = F.lit(float(q)) * (F.col("_size") - 1)
    located = (
        totals.withColumns({
            "_before": F.coalesce(before, F.lit(0)),
            "_size": F.sum(known).over(whole),
            count: F.sum("_m").over(whole),
        })
        .withColumns({"_low": F.floor(rank), "_high": F.ceil(rank), "_frac": rank - F.floor(rank)})
    )

    def holds(position: str, start: Column, length: Column) -> Column:
        return (F.col(position) >= start) & (F.col(position) < start + length)

    here = holds("_low", F.col("_before"), known) | holds("_high", F.col("_before"), known)
    unknown = (F.col("_size") == 0)
    wanted = located.filter(here | unknown).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_wanted"), "_before", "_low", "_high", "_frac", "_min", "_max", count,
    )
    same = F.col("_slice").eqNullSafe(F.col("_wanted"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    facts = ["_before", "_low", "_high", "_frac", count]
    crowded = counts.join(wanted, same).select(
        *keys, "_slice", _part(F.col("_value"), F.col("_min"), F.col("_max")).alias("_part"), "_value", "_n", *facts)
    # the same once more, for the parts of a slice
    parts = crowded.groupBy(*keys, "_slice", "_part").agg(
        F.sum("_n").alias("_m"), *[F.first(c).alias(c) for c in facts])
    earlier = Window.partitionBy("_slice", *keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
    here = holds("_low", F.col("_before"), F.col("_m")) | holds("_high", F.col("_before"), F.col("_m"))
    parts = parts.filter(here | F.col("_slice").isNull()).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_wanted"),
        F.col("_part").alias("_wanted_part"), F.col("_before").alias("_start_of_part"))
    same = same & F.col("_part").eqNullSafe(F.col("_wanted_part"))
    inside = Window.partitionBy("_slice", "_part", *keys).orderBy("_value").rowsBetween(
        Window.unboundedPreceding, -1
    )
    start = F.col("_start_of_part") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    picked = crowded.join(parts, same).withColumn("_start", start)
    low = F.max(F.when(holds("_low", F.col("_start"), F.col("_n")), F.col("_value")))
    high = F.max(F.when(holds("_high", F.col("_start"), F.col("_n")), F.col("_value")))
    return (
        picked.groupBy(*keys)
        .agg(F.max(count).alias(count), low.alias("_lo"), high.alias("_hi"), F.max("_frac").alias("_frac"))
        .select(*keys, count, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
            F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias(out))
    )
