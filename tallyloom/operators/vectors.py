"""Aggregation and arithmetic over step vectors: label columns, ``step``, ``value``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_AGGREGATES = {"sum": F.sum, "max": F.max, "avg": F.avg, "count": F.count, "min": F.min}


def agg(vector: DataFrame, how: str, by: Sequence[str] = ()) -> DataFrame:
    """Aggregate the series of each step, kept apart by the ``by`` labels."""
    return vector.groupBy(*by, "step").agg(
        _AGGREGATES[how]("value").cast("double").alias("value")
    )


def clamp_min(value: str | Column, floor: float) -> Column:
    return F.greatest(F.col(value) if isinstance(value, str) else value, F.lit(float(floor)))


def _apply(op: str, left: Column, right: Column) -> Column:
    if op == "+":
        return left + right
    if op == "-":
        return left - right
    if op == "*":
        return left * right
    if op == "/":
        return F.try_divide(left, right)
    raise ValueError(f"unknown operator {op!r}")


def vector_op(a: DataFrame, b: DataFrame, op: str, on: Sequence[str] | None = None) -> DataFrame:
    """``a op b`` for series with the same ``on`` labels; unmatched series drop.

    ``on`` defaults to every label of ``a``. Each side has one row per ``on`` and
    step, so no join key can be hot. A division by zero gives null.
    """
    keys = [*([c for c in a.columns if c not in ("step", "value")] if on is None else on), "step"]
    left = a.select(*keys, F.col("value").alias("_left"))
    right = b.select(*keys, F.col("value").alias("_right"))
    return left.join(right, keys).select(
        *keys, _apply(op, F.col("_left"), F.col("_right")).alias("value")
    )


def ratio(a: DataFrame, b: DataFrame, floor: float | None = None) -> DataFrame:
    """Ratio of two label-less vectors; ``floor`` keeps the divisor from being too small."""
    if floor is not None:
        b = b.withColumn("value", clamp_min("value", floor))
    return vector_op(a, b, "/", on=[])


def share(
    vector: DataFrame, part: Column, by: Sequence[str] = (), floor: float | None = None
) -> DataFrame:
    """The ratio of sums when both come from one vector: a single pass, no join.

    ``part`` picks the series of the numerator. Steps without such a series drop,
    as they would in the join.
    """
    sums = vector.groupBy(*by, "step").agg(
        F.sum(F.when(part, F.col("value"))).alias("_part"), F.sum("value").alias("_all")
    )
    divisor = F.col("_all") if floor is None else clamp_min("_all", floor)
    return sums.filter(F.col("_part").isNotNull()).select(
        *by, "step", F.try_divide("_part", divisor).alias("value")
    )


def combine(
    vector: DataFrame, parts: Mapping[str, Column], formula: Callable[[Mapping[str, Column]], Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """``formula`` over the sums of several parts of one vector: a single pass, no join.

    ``parts`` names conditions on the labels. Steps where a part has no series drop, as
    they would in a join of the parts.
    """
    sums = vector.groupBy(*by, "step").agg(
        *[F.sum(F.when(part, F.col("value"))).alias(f"_{name}") for name, part in parts.items()])
    known = {name: F.col(f"_{name}") for name in parts}
    return sums.dropna(subset=[f"_{name}" for name in parts]).select(*by, "step", formula(known).alias("value"))


def topk(k: int, vector: DataFrame, by_step: bool = True) -> DataFrame:
    """The ``k`` largest series of each step, or of the whole vector; ties go by labels.

    Spark keeps ``k`` rows per step on each task before the shuffle. A value that is no
    number ranks last.
    """
    labels = [c for c in vector.columns if c not in ("step", "value")]
    order = [F.nanvl("value", F.lit(None)).desc_nulls_last(), *[F.col(c) for c in labels]]
    if not by_step:
        return vector.orderBy(*order, "step").limit(k)
    rank = F.row_number().over(Window.partitionBy("step").orderBy(*order))
    return vector.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
