"""Jobs that remember something between records. They take and return streaming frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.timeaxis import is_ntz, seconds


def _timed(stream: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Watermarks need a timestamp with time zone; a plain one is read in the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def _restored(column: str | Column, ntz: bool) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("timestamp_ntz") if ntz else column


def windowed_counts(
    stream: DataFrame, window: str, keys: list[str], ts: str = "ts", watermark: str = "1 hour"
) -> DataFrame:
    """Records per key and fixed window. Counts are combined before the shuffle.

    Rows whose window closed before the watermark are dropped; ``sinks.late_rows`` counts
    them.
    """
    ntz = is_ntz(stream, ts)
    return (
        _timed(stream, ts, watermark)
        .groupBy(F.window(ts, window).alias("_window"), *keys)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(*keys, _restored("_window.start", ntz).alias("window_start"),
                _restored("_window.end", ntz).alias("window_end"), "events")
    )


def dedup(
    stream: DataFrame, key: str, within: str, ts: str = "ts", salts: int = 1
) -> DataFrame:
    """One record per id, remembered for ``within`` of event time.

    With ``salts`` an id with very many copies is first thinned out on so many tasks, then
    once more as a whole; the first pass doubles the state.
    """
    ntz = is_ntz(stream, ts)
    marked = _timed(stream, ts, within)
    if salts > 1:
        marked = (
            marked.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
            .dropDuplicatesWithinWatermark([key, "_salt"])
            .drop("_salt")
        )
    return marked.dropDuplicatesWithinWatermark([key]).withColumn(ts, _restored(ts, ntz))


def enrich(stream: DataFrame, table: DataFrame, key: str, how: str = "left", salts: int = 1
           ) -> DataFrame:
    """Table columns added to each record by key.

    Spark broadcasts the table if its size is within the broadcast limit, and then the
    stream does not move. For a larger table and a hot key, ``salts`` repeats the table so
    often and joins the key in as many tasks.
    """
    if salts <= 1:
        return stream.join(table, key, how)
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = stream.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def enrich_moving(
    stream: DataFrame, other: DataFrame, key: str, ts: str, other_ts: str, within: str,
    watermark: str = "1 hour", how: str = "inner",
) -> DataFrame:
    """Both sides are streams: join records whose times are at most ``within`` apart.

    Records meet by key and stretch of time, twice ``within`` long, so the state and the
    work of a hot key are spread over time: a left record lies in one stretch, a right
    record is kept in the two, seldom the one, that it reaches.

    ``how="left"`` also hands on, once and with nulls, each record that met none. That is
    known when the watermark, the slower one of both streams, has passed all records that
    it could meet; until then it is state, as are records that may still meet some. A record
    without a key or time meets none, and one without a time is handed on never: no watermark
    passes it.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no stream join {how!r}")
    width = seconds(within)
    reach = F.expr(f"interval {width} seconds")

    def stretch(column: str, shift: int = 0) -> Column:
        return F.floor((F.unix_seconds(F.col(column).cast("timestamp")) + shift) / (2 * width))

    near_left = stream.withColumn("_stretch", stretch(ts))
    near_right = other.withColumn(
        "_stretch", F.explode(F.sequence(stretch(other_ts, -width), stretch(other_ts, width))))
    left = _timed(near_left, ts, watermark).alias("l")
    right = _timed(near_right, other_ts, watermark).alias("r")
    same = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._stretch") == F.col("r._stretch"))
    near = F.col(f"r.{other_ts}").between(F.col(f"l.{ts}") - reach, F.col(f"l.{ts}") + reach)
    added = [F.col(f"r.{c}") for c in other.columns if c not in stream.columns]
    joined = left.join(right, same & near, "left_outer" if how == "left" else "inner").select("l.*", *added).drop("_stretch")
    restored = {ts: _restored(ts, is_ntz(stream, ts))}
    if other_ts in joined.columns:
        restored[other_ts] = _restored(other_ts, is_ntz(other, other_ts))
    return joined.withColumns(restored)


_SEEN = StructType([StructField("at_us", LongType())])


class _FirstMatch(StatefulProcessor):
    """Remembers per key when a record was last handed on; forgets it after the ttl."""

    def __init__(self, ttl_us: int | None):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.seen.get()[0] if self.seen.exists() else None
        if self.ttl_us is None:
            ordered = [min((row["at_us"], row["id"]) for row in rows)] if last is None else []
        else:
            ordered = sorted((row["at_us"], row["id"]) for row in rows)
        for at_us, record_id in ordered:
            if last is not None and at_us - last < (self.ttl_us or 0):
                continue
            last = at_us
            self.seen.update((at_us,))
            if self.ttl_us is not None:
                self.handle.registerTimer((at_us + self.ttl_us) // 1000)
            yield Row(key=key[0], at_us=at_us, id=record_id)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a later match has its own timer
        if self.seen.exists() and (self.seen.get()[0] + self.ttl_us) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def _earliest_per_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the shuffle, each batch of rows sends on one row per key."""
    for batch in batches:
        yield batch.sort_values(["at_us", "id"]).drop_duplicates("key", keep="first")


def first_match(
    stream: DataFrame, key: str, predicate: Column, record_id: str, ttl: str | None = None,
    ts: str = "ts", watermark: str = "1 hour",
) -> DataFrame:
    """The first matching record of each key: ``key``, ``ts``, ``id``; later ones are silent.

    Of the records of one batch the earliest counts. With a ``ttl`` a key matches again
    from a record that is at least that much later than the last one handed on; matches of
    a key are taken in order of time and id, so that records that arrive in order give the
    same answer however they are cut into batches. Then a key's matches of one batch
    are sorted in memory; bound the batch by ``max_files``. Needs the RocksDB state store.
    """
    ntz = is_ntz(stream, ts)
    wanted = stream.filter(predicate).select(
        F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"),
        F.col(record_id).alias("id"))
    thinned = wanted.mapInPandas(_earliest_per_key, wanted.schema) if ttl is None else wanted
    timed = thinned.withColumn("_ts", F.timestamp_micros("at_us")).withWatermark("_ts", watermark)
    found = timed.groupBy("key").transformWithState(
        _FirstMatch(None if ttl is None else seconds(ttl) * 1_000_000), wanted.schema, "Append", "EventTime")
    return found.select("key", _restored(F.timestamp_micros("at_us"), ntz).alias("ts"), "id")
