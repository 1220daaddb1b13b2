"""Range functions on an evaluation grid.

Every function returns the label columns, ``step`` (the evaluation time, a
multiple of the step since 1970) and ``value``. A window is ``[step - w, step)``.

Shared shape: samples are reduced to one row per series and slice of time, in tasks
that each hold one slice. Evaluation times are cut into blocks, at least an hour and
four windows long, and a slice goes to the blocks whose windows reach it: its own and,
from the end of a block, the next. What follows happens per series and block, so the
rows of a series on one task are bounded by block over slice, whatever the time range
and the number of samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import label
from ..functions.timeaxis import floor_time, from_position, interval, is_ntz, seconds, to_position

_MAX_SLICE = 60
_MIN_BLOCK = 3600


def _block_length(reach: int) -> int:
    """Length of a block of evaluation times, a multiple of the window."""
    return reach * max(4, -(-_MIN_BLOCK // reach))


def _into_blocks(rows: DataFrame, reach: int) -> DataFrame:
    """Repeat each row, at ``_at``, into every block ``_span`` with evaluation times in ``(_at, _at + reach]``."""
    length = _block_length(reach)
    # a block is longer than a window, so these are one block or two
    spans = F.array(F.floor(F.col("_at") / length), F.floor((F.col("_at") + reach - 1) / length))
    return rows.withColumn("_span", F.explode(F.array_distinct(spans)))


def _in_block(first: Column, last: Column, reach: int, grid: int) -> Column:
    """Grid positions from first to last that the row's block evaluates."""
    length = _block_length(reach)
    begin = F.col("_span") * length
    return _steps(F.greatest(first, _floor(begin, grid) + grid), F.least(last, _floor(begin + length, grid)), grid)


def _named(samples: DataFrame, labels: Sequence[str], ts: str, value: str, minute: str | None = None) -> DataFrame:
    # labels that are spread by the minute already are texts already: as they are, Spark knows them again
    return samples.select(
        *[label(n).alias(n) if minute is None else F.col(n) for n in labels],
        F.col(ts).alias("ts"),
        F.col(value).cast("double").alias("value"),
        *([] if minute is None else [F.col(minute).alias("_slice")]),
    ).filter(F.col("ts").isNotNull() & F.col("value").isNotNull())


def _steps(first: Column, last: Column, step: int) -> Column:
    """Grid positions from first to last, none if last lies before first."""
    none = F.array().cast("array<bigint>")
    return F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(none)


def _floor(position: Column, width: int) -> Column:
    return position - F.pmod(position, F.lit(width).cast("long"))


def _drop_aware(current: Column, previous: Column) -> Column:
    """Growth since the previous sample; after a reset the counter restarted from zero."""
    return (
        F.when(previous.isNull(), F.lit(0.0))
        .when(current < previous, current)
        .otherwise(current - previous)
    )


def increase(
    samples: DataFrame,
    labels: Sequence[str],
    window: str,
    step: str = "1m",
    ts: str = "ts",
    value: str = "value",
    unique: bool = False,
    minute: str | None = None,
) -> DataFrame:
    """Reset-aware growth of each counter over the window, where it has two samples or more.

    The sum of growth between neighbouring samples that both lie in the window;
    nothing is extrapolated to the window edges, so values differ slightly from
    engines that do. Several samples of a series at one instant count as one,
    the largest; pass ``unique=True`` if there are none. Samples are shuffled once, by
    slice and series; name the column ``minute`` if they are spread that way already, by the
    start of their minute, as ``to_counter`` does when told to keep it.
    """
    reach, grid = seconds(window), seconds(step)
    width = math.gcd(reach, grid)
    slice_width = math.gcd(width, _MAX_SLICE)
    ntz = is_ntz(samples, ts)
    names = list(labels)

    if minute is not None and slice_width == _MAX_SLICE:
        points = _named(samples, names, ts, value, minute)
    else:
        points = _named(samples, names, ts, value).withColumn("_slice", floor_time("ts", slice_width))
    # the slice leads: sorting then compares numbers before it compares labels
    in_slice = Window.partitionBy("_slice", *names).orderBy("ts", "value")
    if not unique:
        after = F.lead("ts").over(in_slice)
        points = points.withColumn("_after", after).filter(F.col("_after").isNull() | (F.col("_after") != F.col("ts")))
    slices = (
        points.withColumn("_growth", _drop_aware(F.col("value"), F.lag("value").over(in_slice)))
        .groupBy("_slice", *names)
        .agg(
            F.sum("_growth").alias("_grown"),
            F.count(F.lit(1)).alias("_points"),
            F.min_by("value", "ts").alias("_first"),
            F.max_by("value", "ts").alias("_last"),
        )
        .withColumn("_at", to_position("_slice", ntz))
    )
    slices = _into_blocks(slices.drop("_slice"), reach)
    # _edge: growth between the last sample of the slice before and the first of this one;
    # of a block's first slice no window holds the one before
    keys = ["_span", *names]
    along = Window.partitionBy(*keys).orderBy("_at")
    slices = slices.withColumn(
        "_edge", _drop_aware(F.col("_first"), F.lag("_last").over(along))
    )
    if slice_width < width:
        slices = (
            slices.withColumn("_bucket", _floor(F.col("_at"), width))
            .groupBy(*keys, "_bucket")
            .agg(
                (F.sum("_grown") + F.sum("_edge") - F.min_by("_edge", "_at")).alias("_grown"),
                F.min_by("_edge", "_at").alias("_edge"),
                F.sum("_points").alias("_points"),
            )
            .withColumnRenamed("_bucket", "_at")
        )
    # Blocks as long as the window: a window is the end of one block and the start of
    # the next, so running sums from both sides of each block replace a sum per window.
    block = Window.partitionBy(*keys, "_block")
    up, down = block.orderBy("_at"), block.orderBy(F.col("_at").desc())
    upto = up.rowsBetween(Window.unboundedPreceding, 0)
    beyond = down.rowsBetween(Window.unboundedPreceding, -1)
    step_in = F.col("_grown") + F.col("_edge")
    # growth into the first bucket of a window came from outside the window
    opening = F.when(F.lag("_at").over(up).isNull(), F.col("_grown")).otherwise(step_in)
    sums = (
        slices.withColumns({
            "_next": F.lead("_at").over(along),
            "_block": F.floor(F.col("_at") / reach),
        })
        .withColumn("_opening", opening)
        .withColumns({
            "_head": F.sum(step_in).over(upto),
            "_head_alone": F.sum("_opening").over(upto),
            "_head_points": F.sum("_points").over(upto),
            "_tail": F.col("_grown") + F.coalesce(F.sum(step_in).over(beyond), F.lit(0.0)),
            "_tail_points": F.col("_points") + F.coalesce(F.sum("_points").over(beyond), F.lit(0)),
        })
    )
    # A bucket answers the evaluation times for which it is the latest bucket. Shifted by the
    # window it also marks, for the times up to there, where their window begins.
    tail = F.struct("_block", "_tail", "_tail_points")
    head = F.struct("_block", "_head", "_head_alone", "_head_points")
    first = _floor(F.col("_at"), grid) + grid
    last = F.least(
        _floor(F.col("_at") + reach, grid),
        F.coalesce(_floor(F.col("_next"), grid), F.col("_at") + reach),
    )
    marker = F.array(F.struct((F.col("_at") + reach).alias("at"), F.lit(False).alias("evaluate")))
    evaluations = F.transform(
        _in_block(first, last, reach, grid), lambda at: F.struct(at.alias("at"), F.lit(True).alias("evaluate")))
    rows = (
        sums.select(*keys, head.alias("_to"), tail.alias("_from"),
                    F.explode(F.concat(marker, evaluations)).alias("_row"))
        .select(*keys, "_row.*", F.when(F.col("_row.evaluate"), F.col("_to")).alias("_to"),
                F.when(~F.col("_row.evaluate"), F.col("_from")).alias("_from"))
    )
    backwards = (
        Window.partitionBy(*keys).orderBy(F.col("at").desc(), "evaluate")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    opened = F.floor((F.col("at") - reach) / reach)
    has_tail = F.col("_from._block") == opened
    has_head = F.col("_to._block") > opened

    def joined(tail_part: str, head_part: str, head_only: str) -> Column:
        both = F.col(f"_from.{tail_part}") + F.col(f"_to.{head_part}")
        return F.when(~has_tail, F.col(f"_to.{head_only}")).when(has_head, both).otherwise(
            F.col(f"_from.{tail_part}"))

    return (
        rows.withColumn("_from", F.last("_from", ignorenulls=True).over(backwards))
        .filter("evaluate")
        .filter(joined("_tail_points", "_head_points", "_head_points") >= 2)
        .select(*names, from_position("at", ntz).alias("step"),
                joined("_tail", "_head", "_head_alone").alias("value"))
    )


def rate(
    samples: DataFrame,
    labels: Sequence[str],
    window: str = "5m",
    step: str = "1m",
    ts: str = "ts",
    value: str = "value",
    unique: bool = False,
    minute: str | None = None,
) -> DataFrame:
    """Growth per second: ``increase`` over the window length."""
    grown = increase(samples, labels, window, step, ts, value, unique, minute)
    return grown.withColumn("value", F.col("value") / F.lit(float(seconds(window))))


def instant(
    samples: DataFrame,
    labels: Sequence[str],
    step: str = "1m",
    lookback: str = "5m",
    ts: str = "ts",
    value: str = "value",
    unique: bool = False,
) -> DataFrame:
    """Last sample of each series before each evaluation time, if within the lookback.

    Of several samples at one instant the largest counts; pass ``unique=True`` if there
    are none, which lets Spark aggregate by hash instead of sorting. The bucket aggregate
    runs before the shuffle; afterwards each bucket is spread over exactly the
    evaluation times it answers.
    """
    reach, grid = seconds(lookback), seconds(step)
    width = math.gcd(reach, grid)
    ntz = is_ntz(samples, ts)
    names = list(labels)
    latest = F.max_by("value", "ts") if unique else F.max(F.struct("ts", "value"))["value"]
    buckets = (
        _named(samples, names, ts, value)
        .withColumn("_bucket", floor_time("ts", width))
        .groupBy(*names, "_bucket")
        .agg(latest.alias("value"))
        .select(*names, to_position("_bucket", ntz).alias("_at"), "value")
    )
    following = F.lead("_at").over(Window.partitionBy("_span", *names).orderBy("_at"))
    first = _floor(F.col("_at"), grid) + grid
    last = F.least(
        _floor(F.col("_at") + reach, grid),
        F.coalesce(_floor(F.col("_next"), grid), F.col("_at") + reach),
    )
    return (
        _into_blocks(buckets, reach).withColumn("_next", following)
        .select(*names, F.explode(_in_block(first, last, reach, grid)).alias("_step"), "value")
        .select(*names, from_position("_step", ntz).alias("step"), "value")
    )


def instant_at(
    samples: DataFrame,
    labels: Sequence[str],
    at: str,
    lookback: str = "5m",
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """The instant lookup at a single time; the time range reaches the scan."""
    kind = "timestamp_ntz" if is_ntz(samples, ts) else "timestamp"
    moment = F.lit(at).cast(kind)
    inside = samples.filter((F.col(ts) >= moment - interval(lookback)) & (F.col(ts) < moment))
    return (
        _named(inside, labels, ts, value)
        .groupBy(*labels)
        .agg(F.max(F.struct("ts", "value")).alias("_latest"))
        .select(*labels, moment.alias("step"), F.col("_latest.value").alias("value"))
    )


def range_query(
    samples: DataFrame,
    start: str,
    end: str,
    expression: Callable[[DataFrame], DataFrame],
    reach: str = "5m",
    ts: str = "ts",
) -> DataFrame:
    """Evaluate an expression for every step from start to end, both included.

    ``reach`` is how far back the expression looks; samples outside
    ``[start - reach, end)`` are never read if they are stored. Counters made of events
    are told their range by ``since`` and ``until`` of ``to_counter``.
    """
    kind = "timestamp_ntz" if is_ntz(samples, ts) else "timestamp"
    first, last = F.lit(start).cast(kind), F.lit(end).cast(kind)
    needed = samples.filter((F.col(ts) >= first - interval(reach)) & (F.col(ts) < last))
    return expression(needed).filter((F.col("step") >= first) & (F.col("step") <= last))
