"""Tables in buckets of their key: joins and upserts by it leave the table where it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import last_of


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """A table of ``buckets`` files at ``path``, each with the keys of one hash, in their order.

    The catalog knows the layout, so choose as many buckets as the table will want tasks.
    Rows lie together already if they come from an upsert of such a table; otherwise they
    are shuffled once.
    """
    (
        df.repartition(buckets, *keys).sortWithinPartitions(*keys)
        .write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    )


def upsert_bucketed(
    spark: SparkSession, table: str, changes: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """A bucketed table with the last write of every changed key, its rows not shuffled.

    The table has one row per key, as an upsert leaves it. Changes go to the bucket of their
    key and meet it there in one pass over the table, however many they are. Of a key's rows
    the one with the largest ``order_by`` counts, ties go to the other columns, as in
    ``tables.upsert``. Rows without a key are compared with none.
    """
    base = spark.table(table)
    rest = [*order_by, *[c for c in base.columns if c not in keys and c not in order_by]]
    fresh = last_of(changes.select(base.columns), keys, order_by).select(
        *keys, F.struct(*rest).alias("_new"))
    stored = base.select(*keys, F.struct(*rest).alias("_old"))
    newer = F.col("_old").isNull() | (F.col("_new") > F.col("_old"))
    met = stored.join(fresh, list(keys), "full_outer").withColumn(
        "_row", F.when(F.col("_new").isNotNull() & newer, F.col("_new")).otherwise(F.col("_old")))
    return met.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in base.columns])


def join_bucketed(spark: SparkSession, left: str, right: str, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Two tables in the same buckets, joined bucket by bucket: neither is shuffled."""
    return spark.table(left).join(spark.table(right).hint("merge"), list(keys), how)


def replace_bucketed(spark: SparkSession, df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """Point the table to new rows, which may be an upsert of itself; its old files stay until removed."""
    fresh = f"{table}_fresh"
    (
        df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(fresh)
    )
    spark.sql(f"DROP TABLE {table}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
