"""Running totals over groups of any size.

A window over a whole group puts that group on one task. Here the group is cut
into slices along its order, each slice is totalled on its own, and the small
table of slice totals carries the sum so far from slice to slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_total(
    df: DataFrame,
    by: Sequence[str],
    slice_col: str,
    order: str,
    amount: str,
    total: str,
    period: Column | None = None,
) -> DataFrame:
    """Add ``total``: the sum of ``amount`` up to and including this row, per ``by``.

    ``by`` columns are non-null, ``order`` is unique inside a ``by`` group, and
    ``slice_col`` never decreases along ``order``. With a ``period``, told from the slice,
    which lies in one, the sum starts again in each. Rows that hold nothing but these
    columns are shuffled once for both, the sums inside slices and those of slices.
    """
    # the slice leads: sorting then compares numbers before it compares labels
    keys = [slice_col, *by]
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    restart = [] if period is None else ["_restart"]
    narrow = set(df.columns) == {*keys, order, amount}
    if narrow:
        df = df.repartition(*keys)
    # the order is part of the totals too, so that both read the same columns of one shuffle
    first = [F.min(order).alias("_first")] if narrow else []
    earlier = (
        Window.partitionBy(*by, *restart).orderBy(slice_col, *["_first"] * narrow)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        df.groupBy(*keys)
        .agg(F.sum(amount).alias("_slice_total"), *first)
        .withColumns({c: period for c in restart})
        .select(*keys, F.coalesce(F.sum("_slice_total").over(earlier), F.lit(0)).alias("_carried"))
    )
    return (
        df.withColumn("_inside", F.sum(amount).over(inside))
        .join(carried, keys)
        .withColumn(total, F.col("_inside") + F.col("_carried"))
        .drop("_inside", "_carried")
    )


def sequence_number(
    df: DataFrame, by: Sequence[str], order: str, number: str, slice_rows: int = 100_000
) -> DataFrame:
    """Add ``number``: 1, 2, 3 ... per ``by`` along ``order``, a unique integer id.

    A slice spans ``slice_rows`` ids, so no task ever holds more rows than that
    of one group.
    """
    sliced = df.withColumns({"_slice": F.coalesce(F.floor(F.col(order) / slice_rows), F.lit(0)), "_one": F.lit(1)})
    return running_total(sliced, by, "_slice", order, "_one", number).drop("_slice", "_one")
