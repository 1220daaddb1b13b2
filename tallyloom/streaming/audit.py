"""What a streaming job did and holds: progress of every batch, and its state next to its position."""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources import files

_PROGRESS = ("query_id string, run_id string, batch_id long, at string, input_rows long, watermark string, "
             "state_rows long, dropped_rows long, duration_ms long")


class ProgressLog(StreamingQueryListener):
    """Keeps the progress of every batch as a small file; a batch that is run again replaces its own.

    Spark itself remembers the last hundred batches, and only while the query object lives.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run_id: str) -> threading.Event:
        return self._ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        states = progress.stateOperators
        files.write_text(self.spark, f"{self.path}/{progress.id}-{progress.batchId:020d}.json", json.dumps({
            "query_id": str(progress.id), "run_id": str(progress.runId), "batch_id": progress.batchId,
            "at": progress.timestamp, "input_rows": progress.numInputRows,
            "watermark": (progress.eventTime or {}).get("watermark"), "state_rows": sum(s.numRowsTotal for s in states),
            "dropped_rows": sum(s.numRowsDroppedByWatermark for s in states), "duration_ms": progress.batchDuration}),
            overwrite=True)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def settle(self, query: StreamingQuery, timeout: float = 60) -> None:
        """Wait until all that an ended query reported is written."""
        if not self._end(query.runId).wait(timeout):
            raise TimeoutError(f"the end of {query.runId} was not reported within {timeout} seconds")


@contextmanager
def progress_log(spark: SparkSession, path: str) -> Iterator[ProgressLog]:
    """Listen to all queries of the session for as long as the block lasts."""
    listener = ProgressLog(spark, path)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch. ``dropped_rows`` are rows behind the watermark, as the operators
    count them: an aggregate sees groups of a task, a deduplication sees records."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], _PROGRESS)
    return spark.read.schema(_PROGRESS).json(path)


def committed_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that a checkpoint has finished; -1 if none."""
    names = files.file_names(spark, f"{checkpoint.rstrip('/')}/commits")
    return max((int(n) for n in names if n.isdigit()), default=-1)


def _state_batch(spark: SparkSession, checkpoint: str, operator: int, partition: int, store: str) -> int:
    """The last batch whose state a partition of a store has written; -1 if none."""
    folder = f"{checkpoint.rstrip('/')}/state/{operator}/{partition}" + ("" if store == "default" else f"/{store}")
    found = (re.match(r"(\d+)[._]", name) for name in files.file_names(spark, folder))
    # a store's version n is the state after batch n - 1
    return max((int(m[1]) for m in found if m), default=0) - 1


def state_audit(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per state store of a stopped query.

    ``operator``, ``store``, ``partitions``, ``state_batch`` (the last batch that every
    partition has written, by its files), ``committed_batch`` (by the commit log, where a
    restart goes on) and ``agrees``: whether all partitions have the state that a restart
    needs. Listings of folders alone; one per partition.
    """
    done = committed_batch(spark, checkpoint)
    stores = spark.read.format("state-metadata").load(checkpoint).select(
        "operatorId", "operatorName", "stateStoreName", "numPartitions").distinct().collect()
    rows = []
    for operator, name, store, partitions in stores:
        written = min(_state_batch(spark, checkpoint, operator, p, store) for p in range(partitions))
        rows.append((name, store, partitions, written, done, written >= done))
    return spark.createDataFrame(
        rows, "operator string, store string, partitions int, state_batch long, committed_batch long, agrees boolean")


def state_rows(spark: SparkSession, checkpoint: str, operator: int = 0, store: str = "default") -> DataFrame:
    """The state as of the last finished batch: ``partition_id`` and the fields of key and value."""
    rows = (
        spark.read.format("statestore").option("operatorId", operator).option("storeName", store)
        .option("batchId", committed_batch(spark, checkpoint)).load(checkpoint)
    )
    return rows.select("partition_id", "key.*", "value.*")
