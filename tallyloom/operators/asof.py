"""Row-wise as-of join: each row with the last row of another table before it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeaxis import floor_time, interval

_LEFT, _RIGHT, _KEY, _SLICE, _TS = "_left", "_right", "_key", "_slice", "_ts"


def _sided(df: DataFrame, by: Sequence[str], ts: str, width: str | int, side: str) -> DataFrame:
    """A side as (keys, slice, time, its columns as one struct)."""
    return df.select(
        *[F.col(k).alias(f"{_KEY}{i}") for i, k in enumerate(by)],
        floor_time(ts, width).alias(_SLICE), F.col(ts).alias(_TS),
        # the time leads, so that structs of a key go by time and ties by the other columns in order
        F.struct(F.col(ts).alias(_TS), *[F.col(c) for c in df.columns]).alias(side))


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, right_ts: str | None = None,
    within: str | int | None = None, how: str = "left", strict: bool = False, width: str | int = "1h",
) -> DataFrame:
    """Left rows, each with the columns of the last ``right`` row of its key that is not later.

    ``strict`` wants it earlier; ``within`` not longer ago than that. Of right rows at one
    instant the one with the largest other columns, in their order, counts. Left rows
    without an answer, also those without a key or time, have nulls (``how="left"``) or are
    left out (``"inner"``). Right columns keep their names, but for the keys; a name that
    both sides have is an error.

    Rows meet by key and slice of time of the given ``width``, so a hot key is as many tasks
    as it has slices. The last row of a slice is carried on to the later ones over a table
    with one row per key and slice; a slice gets it as one more row at its beginning.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"no as-of join {how!r}")
    right_ts = right_ts or ts
    added = [c for c in right.columns if c not in by]
    both = sorted(set(added) & set(left.columns))
    if both:
        raise ValueError(f"both sides have {', '.join(both)}: rename one")
    names = [f"{_KEY}{i}" for i in range(len(by))]

    def complete(at: str) -> Column:
        return reduce(Column.__and__, [F.col(c).isNotNull() for c in (at, *by)])

    asking = _sided(left.filter(complete(ts)), by, ts, width, _LEFT)
    facts = _sided(right.filter(complete(right_ts)), by, right_ts, width, _RIGHT)

    # one row per key and slice, combined before the shuffle: its last fact, and whether anyone asks
    slices = (
        facts.select(*names, _SLICE, _RIGHT, F.lit(False).alias("_asked"))
        .unionByName(asking.select(*names, _SLICE, F.lit(True).alias("_asked")), allowMissingColumns=True)
        .groupBy(*names, _SLICE).agg(F.max(_RIGHT).alias(_RIGHT), F.bool_or("_asked").alias("_asked"))
    )
    earlier = Window.partitionBy(*names).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        slices.withColumn(_RIGHT, F.last(_RIGHT, ignorenulls=True).over(earlier))
        .filter(F.col("_asked") & F.col(_RIGHT).isNotNull())
        .select(*names, _SLICE, F.col(f"{_RIGHT}.{_TS}").alias(_TS), _RIGHT)
    )
    rows = asking.unionByName(facts, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # at one instant facts come before those who ask, or behind them if they have to be earlier
    asks = F.col(_LEFT).isNotNull()
    along = (
        Window.partitionBy(_SLICE, *names).orderBy(F.col(_TS), ~asks if strict else asks, F.col(_RIGHT))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    met = rows.withColumn(_RIGHT, F.last(_RIGHT, ignorenulls=True).over(along)).filter(asks)
    if within is not None:
        recent = F.col(f"{_RIGHT}.{_TS}") >= F.col(_TS) - interval(within)
        met = met.withColumn(_RIGHT, F.when(recent, F.col(_RIGHT)))
    if how == "inner":
        met = met.filter(F.col(_RIGHT).isNotNull())
    else:
        # rows that cannot meet any go past the shuffle: they may be many of one key, null
        unmet = left.filter(~complete(ts)).select(F.struct(*left.columns).alias(_LEFT))
        met = met.select(F.struct(*[f"{_LEFT}.{c}" for c in left.columns]).alias(_LEFT), _RIGHT).unionByName(
            unmet, allowMissingColumns=True)
    return met.select(*[F.col(f"{_LEFT}.{c}").alias(c) for c in left.columns],
                      *[F.col(f"{_RIGHT}.{c}").alias(c) for c in added])
