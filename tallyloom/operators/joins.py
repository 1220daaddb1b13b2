"""Fact-dimension and inventory joins.

Which side is broadcast is left to Spark, which checks sizes against
``spark.sql.autoBroadcastJoinThreshold`` before planning and again at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def fact_dim_topn(
    facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, category: str,
    when: Column | None = None, n: int = 20, out: str = "events",
) -> DataFrame:
    """Facts per category of a dimension, largest first, ``n`` rows.

    Facts are counted per join key before the join: a hot key crosses the network
    as one number, and the dimension only meets one row per key.
    """
    recent = facts if when is None else facts.filter(when)
    per_key = recent.groupBy(F.col(fact_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    side = dim.select(F.col(dim_key).alias("_key"), category)
    return (
        per_key.join(side, "_key")
        .groupBy(category)
        .agg(F.sum("_n").alias(out))
        .orderBy(F.col(out).desc(), category)
        .limit(n)
    )


def preagg_join(
    left: DataFrame, events: DataFrame, left_key: str, event_key: str, category: str,
    when: Column | None = None, out: str = "events",
) -> DataFrame:
    """Events counted per id, joined to the rows of each id, summed per category.

    Left rows repeat an id's count, as the join says, so they are counted per id
    and category first and the count is multiplied.
    """
    recent = events if when is None else events.filter(when)
    per_id = recent.groupBy(F.col(event_key).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    rows = (
        left.filter(F.col(category).isNotNull())
        .groupBy(F.col(left_key).alias("_id"), category)
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    return (
        rows.join(per_id, "_id")
        .groupBy(category)
        .agg(F.sum(F.col("_copies") * F.col("_n")).alias(out))
        .orderBy(F.col(out).desc(), category)
    )


def missing_from(
    left: DataFrame, present_in: DataFrame, absent_from: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Rows of ``left`` whose keys occur in one inventory and not in the other.

    The inventories are reduced to distinct keys before any shuffle, so a key with
    many entries does not load one task.
    """
    return (
        left.join(present_in.select(*keys).distinct(), list(keys), "left_semi")
        .join(absent_from.select(*keys).distinct(), list(keys), "left_anti")
    )


def target_status(
    expected: DataFrame, up: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Each expected target as ``missing`` (no series), ``down`` or ``up`` by its last sample."""
    latest = up.groupBy(*keys).agg(F.max(F.struct(ts, value)).alias("_latest"))
    return expected.join(latest, list(keys), "left").select(
        *expected.columns,
        F.when(F.col("_latest").isNull(), "missing")
        .when(F.col(f"_latest.{value}") > 0, "up")
        .otherwise("down").alias("status"),
    )
