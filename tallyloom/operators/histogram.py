"""Quantiles and means from cumulative histogram buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .vectors import combine


def histogram_quantile(
    q: float, buckets: DataFrame, by: Sequence[str] = (), le: str = "le", value: str = "value"
) -> DataFrame:
    """Quantile by linear interpolation in the first bucket reaching the rank.

    Buckets are summed per ``by`` (and ``step`` if present) and bound first, before
    the shuffle. The first bucket starts at 0. A rank in the +Inf bucket gives the
    highest finite bound. No +Inf bucket, or no observations: null. A count below that of
    a smaller bound, as the restart of a counter can leave it, counts as the larger one.
    """
    return histogram_profile({"value": q}, buckets, by, le, value)


def histogram_profile(
    quantiles: Mapping[str, float], buckets: DataFrame, by: Sequence[str] = (), le: str = "le",
    value: str = "value", mean: str | None = None,
) -> DataFrame:
    """Several quantiles of one histogram, and its ``mean``, from one pass over the buckets.

    The mean needs the sum of the observations as a bucket whose bound is NaN.
    """
    keys = [*by, "step"] if "step" in buckets.columns else list(by)
    summed = buckets.groupBy(*keys, F.col(le).cast("double").alias("_le")).agg(F.sum(value).alias("_sum"))
    infinite = F.lit(float("inf"))
    real = ~F.isnan("_le")  # NaN comes last, behind the infinite bound
    along = Window.partitionBy(*keys).orderBy("_le")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    shaped = (
        summed.withColumn("_count", F.max(F.when(real, F.col("_sum"))).over(upto))
        .withColumns({
            "_lower": F.lag("_le").over(along),
            "_below": F.coalesce(F.lag("_count").over(along), F.lit(0.0)),
            "_total": F.max("_count").over(whole),
            "_top": F.max(F.when(real, F.col("_le"))).over(whole),
        })
    )
    usable = (F.col("_top") == infinite) & (F.col("_total") > 0)
    floor = F.coalesce("_lower", F.lit(0.0))

    def quantile(q: float) -> Column:
        rank = F.lit(float(q)) * F.col("_total")
        inside = floor + (F.col("_le") - floor) * F.try_divide(
            rank - F.col("_below"), F.col("_count") - F.col("_below"))
        answer = (
            F.when(F.col("_le") == infinite, F.col("_lower"))
            .when(F.col("_lower").isNull() & (F.col("_le") <= 0), F.col("_le"))
            .otherwise(inside)
        )
        reached = real & (F.col("_count") >= rank)
        return F.min_by(F.when(usable, answer), F.when(reached, F.col("_le")))

    columns = [quantile(q).alias(name) for name, q in quantiles.items()]
    if mean:
        observed = F.max(F.when(F.isnan("_le"), F.col("_sum")))
        columns.append(F.try_divide(observed, F.max("_total")).alias(mean))
    return shaped.groupBy(*keys).agg(F.count_if(real).alias("_buckets"), *columns).filter("_buckets > 0").drop("_buckets")


def histogram_mean(rates: DataFrame, kind: str = "kind", by: Sequence[str] = ()) -> DataFrame:
    """Mean observation per step: the ``sum`` series over the ``count`` series of one vector."""
    return combine(rates, {"sum": F.col(kind) == "sum", "count": F.col(kind) == "count"},
                   lambda part: F.try_divide(part["sum"], part["count"]), by)
