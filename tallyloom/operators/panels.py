"""Dashboard panels: several named targets over one sample table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.display import legend
from ..functions.labels import Matcher, all_match
from . import ranges
from .histogram import histogram_profile


@dataclass(frozen=True)
class Target:
    """One line of a panel: select series, apply a range function, aggregate, name.

    ``function`` is ``instant``, ``increase`` or ``rate``; ``how`` is None to keep
    every series. ``scale`` multiplies the result. With ``k`` only the ``k`` largest lines of
    each step are shown; ties go by legend.
    """

    legend: str
    matchers: Sequence[Matcher] = ()
    function: str = "instant"
    window: str = "5m"
    how: str | None = "sum"
    by: Sequence[str] = ()
    scale: float = 1.0
    k: int | None = None


def _range_vector(samples: DataFrame, labels: Sequence[str], function: str, window: str, step: str,
                  unique: bool) -> DataFrame:
    if function == "instant":
        return ranges.instant(samples, labels, step, window, unique=unique)
    if function == "increase":
        return ranges.increase(samples, labels, window, step, unique=unique)
    if function == "rate":
        return ranges.rate(samples, labels, window, step, unique=unique)
    raise ValueError(f"unknown range function {function!r}")


def panel(
    samples: DataFrame,
    labels: Sequence[str],
    targets: Sequence[Target],
    step: str = "1m",
    unique: bool = False,
) -> DataFrame:
    """All targets of a panel as ``legend``, ``step``, ``value``.

    Targets sharing a range function and window are answered by one pass over the
    samples: the range function runs once on the series any of them needs, each target
    becomes a conditional aggregate by all labels any of them groups by, and the short
    result is folded to each target's own labels. Only the passes are united.
    """
    passes: dict[tuple[str, str], list[Target]] = {}
    for target in targets:
        passes.setdefault((target.function, target.window), []).append(target)
    return reduce(DataFrame.unionByName, [
        _fold(_range_vector(
            samples.filter(reduce(Column.__or__, [all_match(t.matchers) for t in sharing])),
            labels, function, window, step, unique), labels, sharing)
        for (function, window), sharing in passes.items()
    ])


def _fold(vector: DataFrame, labels: Sequence[str], targets: Sequence[Target]) -> DataFrame:
    groups = [list(labels) if t.how is None else list(t.by) for t in targets]
    finest = [name for name in labels if any(name in by for by in groups)]
    value = F.col("value")
    parts, lines = [], []
    for i, (target, by) in enumerate(zip(targets, groups)):
        mine = all_match(target.matchers)
        reducer = {"max": F.max, "min": F.min}.get(target.how, F.sum)
        parts += [reducer(F.when(mine, value)).alias(f"_v{i}"), F.count_if(mine).alias(f"_n{i}")]
        lines.append(F.struct(
            F.lit(i).alias("target"),
            F.array(*[F.col(name) for name in by]).cast("array<string>").alias("key"),
            legend(target.legend).alias("legend"),
            F.col(f"_v{i}").alias("v"), F.col(f"_n{i}").alias("n"),
        ))
    final = F.lit(None).cast("double")
    for i, target in enumerate(targets):
        whole = {
            "max": F.col("_max"), "min": F.col("_min"), "count": F.col("_n").cast("double"),
            "avg": F.col("_sum") / F.col("_n"),
        }.get(target.how, F.col("_sum"))
        final = F.when(F.col("target") == i, whole * F.lit(float(target.scale))).otherwise(final)
    folded = (
        vector.groupBy(*finest, "step").agg(*parts)
        .select("step", F.explode(F.array(*lines)).alias("_line"))
        .select("step", "_line.*")
        .filter("n > 0")
        .groupBy("target", "key", "legend", "step")
        .agg(F.sum("v").alias("_sum"), F.max("v").alias("_max"), F.min("v").alias("_min"), F.sum("n").alias("_n"))
        .select("target", "key", "legend", "step", final.alias("value"))
    )
    limits = {i: t.k for i, t in enumerate(targets) if t.k is not None}
    if limits:
        allowed = F.create_map(*[F.lit(x) for item in limits.items() for x in item])[F.col("target")]
        order = Window.partitionBy("target", "step").orderBy(
            F.nanvl("value", F.lit(None)).desc_nulls_last(), "legend", "key")
        ranked = folded.withColumn("_rank", F.row_number().over(order))
        folded = ranked.filter(allowed.isNull() | (F.col("_rank") <= allowed))
    return folded.select("legend", "step", "value")


def histogram_panel(
    samples: DataFrame, labels: Sequence[str], quantiles: Mapping[str, float], by: Sequence[str] = (),
    window: str = "5m", step: str = "1m", mean: str | None = None, unique: bool = False,
) -> DataFrame:
    """Quantiles and mean of a histogram as lines ``legend``, ``step``, ``value``: one rate pass for all.

    ``samples`` are bucket counters with ``le``; the mean needs them with the sum. The
    legend is the name of the line, with the ``by`` labels before it.
    """
    rates = ranges.rate(samples, [*labels, "le"], window, step, unique=unique)
    profile = histogram_profile(quantiles, rates, by, mean=mean)
    lines = [*quantiles, *([mean] if mean else [])]
    line = F.explode(F.array(*[F.struct(
        F.concat_ws(" ", *by, F.lit(name)).alias("legend"), F.col(name).alias("value")) for name in lines]))
    return profile.select("step", line.alias("_line")).select("_line.legend", "step", "_line.value")


def reduce_series(
    panel_rows: DataFrame, calcs: Sequence[str] = ("last", "mean", "max"), by: Sequence[str] = ("legend",)
) -> DataFrame:
    """Legend and stat reducers over the panel's range; ``last`` skips nulls."""
    known = F.col("value").isNotNull()
    reducers = {
        "last": F.max_by("value", F.when(known, F.col("step"))).alias("last"),
        "mean": F.avg("value").alias("mean"),
        "max": F.max("value").alias("max"),
        "min": F.min("value").alias("min"),
    }
    return panel_rows.groupBy(*by).agg(*[reducers[c] for c in calcs])
