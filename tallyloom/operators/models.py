"""Ridge regression and run metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def held_out(key: Sequence[str | Column], share: float = 0.2) -> Column:
    """True for the test part: a hash of the key, so the split repeats on any cluster."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in key]
    digest = F.substring(F.sha2(F.concat_ws("|", *texts).cast("binary"), 256), 1, 4)
    return F.conv(digest, 16, 10).cast("int") < int(share * 65536)


def ridge(
    df: DataFrame, features: Sequence[str], label: str, alpha: float, test: Column
) -> DataFrame:
    """One row: row counts of both parts, intercept, coefficients, test mean squared error.

    Minimises the squared error plus ``alpha`` times the squared coefficients; the
    intercept is not penalised. One pass gathers the means and covariances of the
    training part; only these few numbers reach the driver. Rows that lack a feature, the
    label or the part they belong to, or have one that is NaN, are left out of everything and
    counted as ``left_out``. Where the features do not tell one answer, as when one is constant
    and ``alpha`` is 0, the coefficients of least squares and least length are given.
    """
    def known(column: str) -> Column:
        number = F.col(column).cast("double")
        return F.when(~F.isnan(number), number)

    rows = df.select(*[known(f).alias(f) for f in features], known(label).alias("_y"), test.alias("_test"))
    columns = [*features, "_y"]
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(columns))]
    complete = F.col("_test").isNotNull()
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    moments = rows.filter(complete & ~F.col("_test")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    if not moments["n"]:
        raise ValueError("no rows to train on")
    size = len(features)
    spread = np.empty((size, size))
    for i, j in pairs:
        if j < size:
            spread[i, j] = spread[j, i] = moments[f"c{i}_{j}"]
    against_label = np.array([moments[f"c{i}_{size}"] for i in range(size)])
    solved = np.linalg.lstsq(
        moments["n"] * spread + alpha * np.eye(size), moments["n"] * against_label, rcond=1e-13)[0]
    weights = [float(w) for w in solved]
    intercept = moments[f"m{size}"] - sum(w * moments[f"m{i}"] for i, w in enumerate(weights))
    predicted = reduce(
        Column.__add__, [F.col(f) * F.lit(w) for f, w in zip(features, weights)], F.lit(float(intercept)))
    error = F.col("_y") - predicted
    return rows.agg(
        F.count_if(complete & ~F.col("_test")).alias("train_rows"),
        F.count_if(complete & F.col("_test")).alias("test_rows"),
        F.count_if(~complete).alias("left_out"),
        F.avg(F.when(complete & F.col("_test"), error * error)).alias("mse"),
    ).select(
        "train_rows", "test_rows", "left_out", F.lit(float(intercept)).alias("intercept"),
        *[F.lit(w).alias(f"coef_{f}") for f, w in zip(features, weights)], "mse",
    )


def run_metrics(
    df: DataFrame, run: str = "run_id", key: str = "key", step: str = "step",
    value: str = "value", smaller_is_better: bool = True,
) -> DataFrame:
    """Per run and key: last value and step, best value and the first step reaching it."""
    best = F.min(F.struct(F.col(value), F.col(step))) if smaller_is_better else F.max(
        F.struct(F.col(value), (-F.col(step)).alias(step)))
    best_step = F.col(f"_best.{step}") if smaller_is_better else -F.col(f"_best.{step}")
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(run, key)
        .agg(F.count(F.lit(1)).alias("steps"), F.max(F.struct(step, value)).alias("_last"),
             best.alias("_best"))
        .select(run, key, "steps", F.col(f"_last.{value}").alias("last_value"),
                F.col(f"_last.{step}").alias("last_step"),
                F.col(f"_best.{value}").alias("best_value"), best_step.alias("best_step"))
    )
