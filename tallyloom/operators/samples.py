"""Event facts as metric samples: label columns, ``ts`` and ``value``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import label
from ..functions.timeaxis import calendar, floor_time, is_ntz, known, seconds
from .prefix import running_total


def to_counter(
    events: DataFrame,
    labels: Mapping[str, str | Column],
    ts: str = "ts",
    amount: Column | None = None,
    reset: str | None = "day",
    scrape: str | None = None,
    slice_width: str = "1m",
    since: str | None = None,
    until: str | None = None,
    minute: str | None = None,
) -> DataFrame:
    """Cumulative counter per label set, starting again each ``reset`` period.

    One sample per series and instant (or per ``scrape`` interval, stamped at its
    start). ``amount`` is what one event adds, 1 if not given. Events are summed
    per instant before any shuffle, so a burst of copies costs one row.

    ``since`` and ``until`` ask for the samples of ``[since, until)`` alone: then only events
    from the start of the period of ``since`` are read, a range that reaches the scan.
    ``minute`` names a column to keep, the start of the slice by which the samples lie
    together: range functions that are told of it do not shuffle them again.
    """
    if reset not in (None, "hour", "day", "week", "month", "quarter", "year"):
        raise ValueError(f"cannot restart each {reset}")
    if 3600 % seconds(slice_width):
        raise ValueError(f"slices of {slice_width} do not fit into an hour")
    names = list(labels)
    ntz = is_ntz(events, ts)
    kind = "timestamp_ntz" if ntz else "timestamp"
    if since is not None and reset:
        begin = F.date_trunc(reset, F.lit(since).cast("timestamp")).cast(kind)
        events = events.filter(F.col(ts) >= begin)
    if until is not None:
        events = events.filter(F.col(ts) < F.lit(until).cast(kind))
    facts = events.select(
        *[label(c).alias(n) for n, c in labels.items()],
        F.col(ts).alias("ts"),
        (F.lit(1) if amount is None else amount).alias("_amount"),
    ).filter(F.col("ts").isNotNull())
    if scrape:
        facts = facts.withColumn("ts", floor_time("ts", scrape))
    instants = facts.groupBy(*names, "ts").agg(F.sum("_amount").alias("_amount"))
    sliced = instants.withColumn("_slice", known(floor_time("ts", slice_width), ntz))
    period = known(calendar("_slice", reset, ntz), ntz) if reset else None
    total = running_total(sliced, names, "_slice", "ts", "_amount", "value", period)
    kept = [] if minute is None else [F.col("_slice").alias(minute)]
    samples = total.select(*names, "ts", F.col("value").cast("double").alias("value"), *kept)
    return samples if since is None else samples.filter(F.col("ts") >= F.lit(since).cast(kind))


def to_bucket_counters(
    events: DataFrame,
    labels: Mapping[str, str | Column],
    measure: str,
    bounds: Sequence[float],
    ts: str = "ts",
    scrape: str = "1m",
    reset: str | None = "day",
    with_sum: bool = False,
) -> DataFrame:
    """Cumulative histogram counters: label columns, ``le``, ``ts``, ``value``.

    All bounds are counted in one aggregation per scrape interval; only the
    small result is turned into one row per bound. ``with_sum`` adds the sum of the
    measure as a bucket with the bound NaN.
    """
    names = list(labels)
    ntz = is_ntz(events, ts)
    facts = events.select(
        *[label(c).alias(n) for n, c in labels.items()], F.col(ts).alias("ts"), F.col(measure)
    ).filter(F.col("ts").isNotNull() & F.col(measure).isNotNull())
    counted = (
        facts.withColumn("ts", floor_time("ts", scrape))
        .groupBy(*names, "ts")
        .agg(*[F.count_if(F.col(measure) <= F.lit(float(b))).alias(f"_b{i}")
               for i, b in enumerate(bounds)], F.sum(measure).cast("double").alias("_sum"))
    )
    parts = [(b, F.col(f"_b{i}").cast("double")) for i, b in enumerate(bounds)]
    parts += [(float("nan"), F.col("_sum"))] if with_sum else []
    rows = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), n.alias("n")) for b, n in parts]))
    by = [*names, "le"]
    long = counted.withColumn("_b", rows).select(*names, "_b.le", "ts", F.col("_b.n").alias("_n"))
    long = long.withColumn("_slice", known(calendar("ts", "hour", ntz), ntz))
    period = known(calendar("_slice", reset, ntz), ntz) if reset else None
    total = running_total(long, by, "_slice", "ts", "_n", "value", period)
    return total.select(*names, "le", "ts", F.col("value").cast("double").alias("value"))


def bucket_counts(
    df: DataFrame, by: Sequence[str], measure: str, bounds: Sequence[float]
) -> DataFrame:
    """Cumulative count per bound: ``by``, ``le``, ``value``. One scan, rows split afterwards."""
    counted = df.groupBy(*by).agg(*[
        F.count_if(F.col(measure) <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)
    ])
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").cast("double").alias("value"))
        for i, b in enumerate(bounds)
    ]))
    return counted.withColumn("_b", rows).select(*by, "_b.le", "_b.value")
