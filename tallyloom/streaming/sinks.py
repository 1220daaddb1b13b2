"""Where streams end: rerunnable batch writes, dead letters, latest state, replays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.records import json_error
from ..functions.timeaxis import seconds
from ..sources import files, tables, versions

_SHUFFLE = "spark.sql.shuffle.partitions"


def run_available(
    stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None],
    mode: str = "append", partitions: int | None = None,
) -> StreamingQuery:
    """Process everything there is, then stop. The same checkpoint continues next time.

    ``partitions`` is the number of state partitions, by default the session's shuffle
    partitions. The first run of a checkpoint fixes it: choose it for the stream to come.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_SHUFFLE)
    spark.conf.set(_SHUFFLE, str(partitions or before))
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .foreachBatch(each_batch)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(_SHUFFLE, before)
    query.awaitTermination()
    return query


def idempotent_sink(
    path: str, keys: Sequence[str] | None = None, order_by: Sequence[str] = (), buckets: int = 64,
) -> Callable[[DataFrame, int], None]:
    """A batch written again leaves the sink as it was.

    Without ``keys`` a batch goes to the folder of its number, so a repeated batch replaces
    itself; such a sink belongs to one checkpoint. With ``keys`` the sink is a table with
    one row per key, cut into ``buckets`` by a hash of the key: a batch rewrites the buckets
    it touches, and of a key's rows the one with the largest ``order_by`` stays. That also
    holds for a run on a new checkpoint, which sees old rows again. A batch that touches
    every bucket rewrites the table: where batches are small, use ``delta_sink``.
    """
    if keys is None:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

        return write

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucketed = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        if files.exists(spark, path):
            touched = bucketed.select("_bucket").distinct()
            base = spark.read.schema(bucketed.schema).parquet(path).join(F.broadcast(touched), "_bucket", "left_semi")
            base = base.select(bucketed.columns)
        else:
            base = bucketed.filter(F.lit(False))
        merged = tables.last_of(base.unionByName(bucketed), [*keys, "_bucket"], order_by)
        tables.overwrite_partitions(merged, path, "_bucket")

    return merge


def keyed_table(spark: SparkSession, path: str) -> DataFrame:
    """What a sink with keys holds."""
    return spark.read.parquet(path).drop("_bucket")


_PARTS, _VERSIONS = "parts", "_versions"


def _live(spark: SparkSession, path: str) -> tuple[int, dict]:
    number, state = versions.last(spark, f"{path}/{_VERSIONS}")
    return number, state or {"parts": []}


def _parts(spark: SparkSession, path: str, state: dict) -> DataFrame:
    return spark.read.schema(StructType.fromJson(state["schema"])).option("basePath", f"{path}/{_PARTS}").parquet(
        *[f"{path}/{_PARTS}/{part}" for part in state["parts"]]).drop("part")


def delta_sink(path: str, keys: Sequence[str], order_by: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A table with one row per key, to which a batch adds no more than its own rows.

    A batch is a part of its own, with the last row of each of its keys; reading takes the
    last row over all parts, by the largest ``order_by``, ties by the other columns. So a batch
    that comes again, on whatever checkpoint, changes nothing. Fold the parts now and then.
    """
    path = path.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, part = batch.sparkSession, f"part={uuid.uuid4().hex}"
        tables.last_of(batch, keys, order_by).write.parquet(f"{path}/{_PARTS}/{part}")
        told = {"schema": batch.schema.jsonValue(), "keys": list(keys), "order_by": list(order_by)}
        while True:
            number, state = _live(spark, path)
            try:
                return versions.publish(spark, f"{path}/{_VERSIONS}", number + 1, {**told, "parts": [*state["parts"], part]})
            except versions.Conflict:
                continue  # parts may be added in any order

    return write


def delta_table(spark: SparkSession, path: str) -> DataFrame:
    """What a ``delta_sink`` holds."""
    path = path.rstrip("/")
    state = _live(spark, path)[1]
    if not state["parts"]:
        raise ValueError(f"there is no table at {path}")
    return tables.last_of(_parts(spark, path, state), state["keys"], state["order_by"])


def fold_deltas(spark: SparkSession, path: str) -> None:
    """Make one part of all that are there; parts that arrive meanwhile stay.

    Readers of the parts before should be done: their files are removed.
    """
    path = path.rstrip("/")
    folded, part = _live(spark, path)[1], f"part={uuid.uuid4().hex}"
    tables.last_of(_parts(spark, path, folded), folded["keys"], folded["order_by"]).write.parquet(f"{path}/{_PARTS}/{part}")
    while True:
        number, state = _live(spark, path)
        left = [p for p in state["parts"] if p not in folded["parts"]]
        try:
            versions.publish(spark, f"{path}/{_VERSIONS}", number + 1, {**state, "parts": [part, *left]})
            break
        except versions.Conflict:
            continue
    for old in folded["parts"]:
        files.remove(spark, f"{path}/{_PARTS}/{old}")


def sink_table(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """What the sink holds: per key the row of its last batch (update mode emits a key again)."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return (
        rows.groupBy(*keys)
        .agg(F.max(F.struct("batch_id", *rest)).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
    )


def appended(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a sink whose batches do not repeat keys."""
    return spark.read.parquet(path).drop("batch_id")


def late_rows(
    stream: DataFrame, checkpoint: str, path: str, window: str, ts: str = "ts", watermark: str = "1 hour",
) -> DataFrame:
    """Rows that ``windowed_counts`` drops: those whose window the watermark had closed.

    Runs over what there is, as a reader of its own, and keeps a row per batch under
    ``path``: ``batch_id``, ``late`` and ``newest``, the latest time so far. The watermark of
    a batch comes from the batches before it, as Spark's does, so a run over the same
    batches counts what the job dropped. Rows are counted one by one, before any
    aggregation, and over all batches of the checkpoint. Returns the total, ``late_rows``.
    """
    spark = stream.sparkSession
    width, delay = seconds(window), seconds(watermark)
    log_schema = "late long, newest long"

    def count(batch: DataFrame, batch_id: int) -> None:
        newest = None
        if files.exists(spark, path):
            before = spark.read.schema(f"{log_schema}, batch_id long").parquet(path).filter(F.col("batch_id") < batch_id)
            newest = before.agg(F.max("newest")).first()[0]
        at = F.unix_micros(F.col(ts).cast("timestamp"))
        end = (F.floor(at / (width * 1_000_000)) + 1) * width * 1_000_000
        late = F.lit(False) if newest is None else end <= newest - delay * 1_000_000
        batch.agg(
            F.count_if(late).alias("late"), F.greatest(F.max(at), F.lit(newest).cast("long")).alias("newest"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_available(stream, checkpoint, count)
    if not files.exists(spark, path):
        return spark.range(1).select(F.lit(0).cast("long").alias("late_rows"))
    return spark.read.schema(f"{log_schema}, batch_id long").parquet(path).agg(
        F.coalesce(F.sum("late"), F.lit(0)).alias("late_rows"))


def marked_letters(log: DataFrame, schema: str | StructType) -> DataFrame:
    """Every record once: its context, the typed fields, ``error_class`` and ``payload``.

    A good record has no error class and no payload; a dead one has no fields.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    parsed, error = json_error("value", fields)
    marked = log.withColumns({"_parsed": parsed, "error_class": error})
    good = F.col("error_class").isNull()
    return marked.select(
        *[c for c in log.columns if c != "value"],
        *[F.when(good, F.col(f"_parsed.{f}")).alias(f) for f in fields.fieldNames()],
        "error_class", F.when(~good, F.col("value")).alias("payload"))


def split_dead_letters(log: DataFrame, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """Records with a readable payload, typed, and the others with all their context.

    Works on a batch or a stream. Dead letters keep partition, offset, key, timestamp
    and payload (and the topic, if there is one) next to the class of the error: see
    ``json_error``. Every record is in exactly one of the two.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    marked = marked_letters(log, fields)
    good = marked.filter(F.col("error_class").isNull()).drop("error_class", "payload")
    return good, marked.filter(F.col("error_class").isNotNull()).drop(*fields.fieldNames())


def dead_letter_sink(schema: str | StructType, path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch once, good and dead records in folders of their own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        marked = marked_letters(batch, schema)
        marked.withColumn("good", F.col("error_class").isNull()).write.mode("overwrite").partitionBy("good").parquet(
            f"{path}/batch_id={batch_id}")

    return write


def stored_letters(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(good records, dead letters) of a ``dead_letter_sink``."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = spark.read.parquet(path)
    good = rows.filter("good = 'true'").drop("good", "batch_id", "error_class", "payload")
    return good, rows.filter("good = 'false'").drop("good", "batch_id", *fields.fieldNames())


def latest_by_key(
    df: DataFrame, key: str, order: Sequence[str], deleted: Column | None = None
) -> DataFrame:
    """Last record of each key by ``order``; a key whose last record is a delete is gone."""
    rest = [c for c in df.columns if c != key and c not in order]
    last = (
        df.groupBy(key)
        .agg(F.max(F.struct(*order, *rest)).alias("_last"))
        .select(key, *[F.col(f"_last.{c}").alias(c) for c in [*order, *rest]])
    )
    return last if deleted is None else last.filter(~deleted)


def replay(
    source: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Run a source again as a reader of its own; a used checkpoint is refused."""
    if files.exists(source.sparkSession, checkpoint):
        raise ValueError(f"a replay needs a new checkpoint, {checkpoint} is in use")
    return run_available(source, checkpoint, each_batch)
