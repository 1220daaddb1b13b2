"""Rollups kept by signed changes: what changed is added to stored sums, raw rows are not read again.

A rollup is a folder of parts, each the sums of some changes per bucket and group, and of
versions that say which parts are live and which batches they hold. Reading adds the parts
up; folding replaces them by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.timeaxis import calendar, is_ntz
from . import files, versions

#: Digits before and behind the point of a stored sum. Decimals add up exactly, so that a
#: value that is taken back leaves nothing behind.
DIGITS = (38, 9)
_VERSIONS, _PARTS = "_versions", "parts"
_STATES = ["rows", "values", "total"]


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Rows with a sign: 1 for what is new, -1 for what is gone. An update is its old and its new row."""
    signed = [df.withColumn("_sign", F.lit(sign)) for df, sign in ((inserted, 1), (deleted, -1)) if df is not None]
    return signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    number, content = versions.last(spark, f"{path}/{_VERSIONS}")
    return number, content or {"parts": [], "batches": []}


def apply_changes(
    signed: DataFrame, path: str, by: Sequence[str], measure: str, batch: str,
    grain: str = "hour", ts: str = "ts",
) -> bool:
    """Add signed rows to a rollup; a batch that it holds already is left out. Returns whether it was added.

    Only the changes are read. Per bucket and group the rows, the values that are neither
    null nor NaN, and their sum are kept; rows without a time belong to no bucket. Values
    beyond the digits of a stored sum are an error.
    """
    spark, path = signed.sparkSession, path.rstrip("/")
    number, state = _state(spark, path)
    if batch in state["batches"]:
        return False
    number_of = F.col(measure).cast("double")
    exact = F.when(number_of.isNotNull() & ~F.isnan(number_of), F.col(measure).cast(f"decimal{DIGITS}"))
    parts = (
        signed.filter(F.col(ts).isNotNull())
        .groupBy(F.to_date(ts).alias("day"), calendar(ts, grain, is_ntz(signed, ts)).alias("bucket"), *by)
        .agg(F.sum("_sign").alias("rows"), F.sum(F.when(exact.isNotNull(), F.col("_sign")).otherwise(0)).alias("values"),
             F.sum(exact * F.col("_sign")).cast(f"decimal{DIGITS}").alias("total"))
    )
    part = f"{_PARTS}/part={uuid.uuid4().hex}"
    parts.hint("rebalance", "day").write.partitionBy("day").parquet(f"{path}/{part}")
    _publish(spark, path, number, {
        "parts": [*state["parts"], part], "batches": [*state["batches"], batch], "schema": parts.schema.jsonValue()}, [part])
    return True


def _publish(spark: SparkSession, path: str, number: int, state: dict, fresh: Sequence[str]) -> None:
    try:
        versions.publish(spark, f"{path}/{_VERSIONS}", number + 1, state)
    except versions.Conflict:
        for part in fresh:
            files.remove(spark, f"{path}/{part}")
        raise


def _sums(spark: SparkSession, path: str, state: dict) -> DataFrame:
    """The live parts added up, without buckets that nothing is left of."""
    if not state["parts"]:
        raise ValueError(f"there is no rollup at {path}")
    every = spark.read.schema(StructType.fromJson(state["schema"])).option("basePath", f"{path}/{_PARTS}").parquet(
        *[f"{path}/{p}" for p in state["parts"]]).drop("part")
    keys = [c for c in every.columns if c not in _STATES]
    return (
        every.groupBy(*keys)
        .agg(*[F.sum(c).cast(every.schema[c].dataType).alias(c) for c in _STATES])
        .filter((F.col("rows") != 0) | (F.col("values") != 0) | (F.col("total") != 0))
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """``day``, ``bucket``, the groups, ``rows``, ``total`` and ``mean``; a filter on the day reaches the scan."""
    path = path.rstrip("/")
    sums = _sums(spark, path, _state(spark, path)[1])
    keys = [c for c in sums.columns if c not in _STATES]
    return sums.select(
        *sorted(keys, key=["day", "bucket"].__contains__, reverse=True), "rows", F.col("total").cast("double").alias("total"),
        F.try_divide(F.col("total").cast("double"), F.col("values")).alias("mean"))


def fold(spark: SparkSession, path: str, keep_old: bool = False) -> str:
    """Replace the live parts by one that holds their sums; readers of an older version need ``keep_old``."""
    path = path.rstrip("/")
    number, state = _state(spark, path)
    part = f"{_PARTS}/part={uuid.uuid4().hex}"
    _sums(spark, path, state).hint("rebalance", "day").write.partitionBy("day").parquet(f"{path}/{part}")
    _publish(spark, path, number, {**state, "parts": [part]}, [part])
    if not keep_old:
        for old in state["parts"]:
            files.remove(spark, f"{path}/{old}")
    return part
