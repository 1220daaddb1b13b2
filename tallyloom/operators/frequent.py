"""Keys that hold a large share of the rows, in bounded memory."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def _lowered(counts: pd.Series, most: int) -> pd.Series:
    """At most ``most`` counts, all lowered by the largest one that does not fit."""
    if len(counts) <= most:
        return counts
    over = counts.nlargest(most + 1).iloc[-1]
    return (counts - over)[counts > over]


def _summary(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's frequent keys, each counted too low by at most rows / (most + 1), and its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = pd.Series(dtype="int64"), 0
        for batch in batches:
            rows += batch.num_rows
            counted = batch.column(0).value_counts()
            fresh = pd.Series(counted.field("counts").to_numpy(), index=counted.field("values").to_pylist())
            held = _lowered(held.add(fresh, fill_value=0).astype("int64"), most)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*held.index, None], pa.string()), pa.array([*held, rows], pa.int64())], ["key", "n"])

    return run


def heavy_keys(df: DataFrame, share: float = 0.01, key: str = "key") -> DataFrame:
    """The keys with at least that share of the rows: ``key`` as text, ``records``, ``share``.

    No row is shuffled by its key. Each task keeps 4 / ``share`` counters; these add up to at
    most 2 / ``share`` candidates, which a second pass counts exactly, combined in each task.
    Null counts as a key.
    """
    if not 0 < share <= 1:
        raise ValueError(f"not a share: {share}")
    # a mark before each text keeps null apart from the empty one
    keys = df.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key"))
    summaries = keys.mapInArrow(_summary(math.ceil(4 / share)), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # the row without a key has the number of all rows; a heavy key's count is too low by
    # a quarter at most, and no more than 2 / share keys can have half of what makes one heavy
    top = summaries.orderBy(F.col("key").isNotNull(), F.desc("n"), "key").limit(math.ceil(2 / share) + 1).collect()
    total = top[0]["n"] if top else 0
    candidates = [(row["key"],) for row in top[1:] if row["n"] >= total * share / 2]
    found = df.sparkSession.createDataFrame(candidates, "key string")
    return (
        keys.join(F.broadcast(found), "key").groupBy("key").agg(F.count(F.lit(1)).alias("records"))
        .withColumn("share", F.col("records") / F.lit(max(total, 1)))
        .filter(F.col("records") >= total * share)
        .select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("key"), "records", "share")
    )
