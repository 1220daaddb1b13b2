"""Reading a partitioned log, and reports about it.

A log is any frame, streaming or not, with ``partition``, ``offset``, ``key``,
``value`` and ``timestamp``; a topic and headers may come along.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.records import typed_props
from ..sources import files

_SLICE_OFFSETS = 100_000


def stream_files(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None
                 ) -> DataFrame:
    """Stream the Parquet files of a folder, or a single Parquet file."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if files.is_file(spark, path):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def end_positions(log: DataFrame) -> dict[int, int]:
    """Last offset per partition; as many numbers as the log has partitions."""
    ends = log.groupBy("partition").agg(F.max("offset").alias("offset")).collect()
    return {row["partition"]: row["offset"] for row in ends}


def _after(positions: Mapping[int, int]) -> Column:
    if not positions:
        return F.lit(True)
    known = F.create_map(*[F.lit(x).cast("long") for item in positions.items() for x in item])
    last = F.coalesce(F.try_element_at(known, F.col("partition").cast("long")), F.lit(-1))
    return F.col("offset") > last


def read_log(
    spark: SparkSession,
    path: str,
    log_schema: StructType,
    start: str | Mapping[int, int] = "earliest",
    schema: str | StructType | None = None,
    defaults: Mapping[str, object] | None = None,
    max_files: int | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Stream a log from ``"earliest"``, ``"latest"`` or after given offsets per partition.

    ``latest`` means after what the log held when the query first started. These positions
    are kept next to the query's ``checkpoint``, which ``latest`` needs, and used again by
    every later start, so that what arrives between two runs is read. A checkpoint that
    was begun without them resumes where it stopped. ``schema`` types the payload: fields
    it does not name are ignored, fields the payload lacks take their default.
    """
    records = stream_files(spark, path, log_schema, max_files)
    if start == "latest":
        if not checkpoint:
            raise ValueError("latest needs the checkpoint of the query that reads")
        start = _first_end(spark, path, log_schema, checkpoint)
    if start != "earliest":
        records = records.filter(_after(start))
    if schema is None:
        return records
    return typed_props(records, schema, "value", defaults)


def _first_end(spark: SparkSession, path: str, log_schema: StructType, checkpoint: str) -> str | dict[int, int]:
    """Where the log ended when the checkpoint was new."""
    kept = f"{checkpoint.rstrip('/')}.start.json"
    text = files.read_text(spark, kept)
    if text is not None:
        return {int(partition): offset for partition, offset in json.loads(text).items()}
    if files.exists(spark, checkpoint):
        return "earliest"
    ends = end_positions(spark.read.schema(log_schema).parquet(path))
    files.write_text(spark, kept, json.dumps(ends))
    return ends


def consumer_lag(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Records between each group's committed position and the end of each partition.

    A committed offset is the next one to read. Without a commit the group has
    everything still ahead of it.
    """
    bounds = log.groupBy("partition").agg(
        F.min("offset").alias("begin"), (F.max("offset") + 1).alias("end"))
    # one entry per log partition, handed to each group as a value
    partitions = bounds.agg(F.collect_list(F.struct("partition", "begin", "end")).alias("p")).scalar()
    groups = commits.select("group").distinct().select("group", F.explode(partitions).alias("_p"))
    committed = commits.groupBy("group", "partition").agg(F.max("offset").alias("committed"))
    return (
        groups.select("group", "_p.*")
        .join(committed, ["group", "partition"], "left")
        .select("group", "partition", "end", "committed",
                (F.col("end") - F.coalesce("committed", "begin")).alias("lag"))
    )


def group_lag(lag: DataFrame) -> DataFrame:
    return lag.groupBy("group").agg(F.sum("lag").alias("lag"))


def order_check(log: DataFrame) -> DataFrame:
    """Records per key and partition, and how many are older than the record before them.

    A key is checked in slices of offsets, which bounds the rows of one task; slices
    are then compared by their first and last timestamps.
    """
    sliced = log.withColumn("_slice", F.floor(F.col("offset") / _SLICE_OFFSETS))
    inside = Window.partitionBy("_slice", "partition", "key").orderBy("offset")
    slices = (
        sliced.select("partition", "key", "_slice", "offset", "timestamp")
        .withColumn("_late", F.col("timestamp") < F.lag("timestamp").over(inside))
        .groupBy("partition", "key", "_slice")
        .agg(
            F.count(F.lit(1)).alias("_records"),
            F.count_if("_late").alias("_out"),
            F.min_by("timestamp", "offset").alias("_first"),
            F.max_by("timestamp", "offset").alias("_last"),
        )
    )
    along = Window.partitionBy("partition", "key").orderBy("_slice")
    edge = (F.col("_first") < F.lag("_last").over(along)).cast("int")
    return (
        slices.withColumn("_edge", F.coalesce(edge, F.lit(0)))
        .groupBy("partition", "key")
        .agg(F.sum("_records").alias("records"), F.sum(F.col("_out") + F.col("_edge")).alias("out_of_order"))
    )


def key_skew(log: DataFrame, hot_share: float = 0.1) -> DataFrame:
    """Records and share of the log per key, with the keys that are hot marked."""
    counts = log.groupBy("key").agg(F.count(F.lit(1)).alias("records"))
    total = counts.agg(F.sum("records").alias("n")).scalar()
    share = F.try_divide(F.col("records"), total)
    return counts.select("key", "records", share.alias("share"), (share >= hot_share).alias("hot"))
