"""A partitioned log that is read by offsets: a streaming source that opens only what it needs.

A log is a folder. Every append writes Parquet files and then one small commit file, which
names them with the partition and the offsets each holds, and the end of every partition.
A reader's position is an offset per partition; from the commits it knows which files lie
between two positions, and opens no other, nor row groups outside them. The end of the log is
in its last commit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources import files, remote, versions

FORMAT = "offset_log"
_COMMITS, _DATA = "_commits", "data"


class LogConflict(ValueError):
    """An append that does not continue the log."""


def _last_commit(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, content) of the last commit; (-1, nothing) of a new log."""
    number, content = versions.last(spark, f"{path}/{_COMMITS}")
    return number, content or {"ends": {}, "files": []}


def ends(spark: SparkSession, path: str) -> dict[int, int]:
    """The offset behind the last record of each partition, from one small file."""
    return {int(p): o for p, o in _last_commit(spark, path)[1]["ends"].items()}


def append(records: DataFrame, path: str) -> dict[int, int]:
    """Add records with ``partition`` and ``offset``; returns the new ends.

    The offsets of each partition continue the log without gaps or repeats, else nothing is
    added and ``LogConflict`` is raised, as when another writer commits at the same time.
    """
    spark, path = records.sparkSession, path.rstrip("/")
    number, before = _last_commit(spark, path)
    target = f"{path}/{_DATA}/{number + 1:020d}-{spark.range(1).select(F.uuid()).first()[0]}"
    kind = "spark.sql.parquet.outputTimestampType"
    old = spark.conf.get(kind)
    spark.conf.set(kind, "TIMESTAMP_MICROS")
    try:
        # ranges of (partition, offset): a large partition is cut, and no file overlaps another
        (records.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset")
         .write.partitionBy("partition").parquet(target))
    finally:
        spark.conf.set(kind, old)
    written = spark.read.schema("offset long, partition long").parquet(target).groupBy(
        "partition", F.col("_metadata.file_path").alias("file")).agg(
        F.min("offset").alias("first"), F.max("offset").alias("last"), F.count("offset").alias("rows")).collect()
    now = dict(before["ends"])
    added = []
    for row in sorted(written, key=lambda r: (r["partition"], r["first"])):
        part = str(row["partition"])
        if row["first"] != now.get(part, 0) or row["rows"] != row["last"] - row["first"] + 1:
            files.remove(spark, target)
            raise LogConflict(f"partition {part} goes on at {now.get(part, 0)}, not with {row['rows']} records "
                              f"from {row['first']} to {row['last']}")
        now[part] = row["last"] + 1
        name = f"{target[len(path) + 1:]}/partition={part}/{row['file'].rsplit('/', 1)[1]}"
        added.append([row["partition"], row["first"], row["last"], name])
    if added:
        try:
            versions.publish(spark, f"{path}/{_COMMITS}", number + 1, {
                "ends": now, "files": added, "schema": records.schema.jsonValue()})
        except versions.Conflict as error:
            files.remove(spark, target)
            raise LogConflict(str(error)) from error
    return {int(p): o for p, o in now.items()}


def read(
    spark: SparkSession, path: str, start: str | Mapping[int, int] = "earliest", checkpoint: str | None = None,
) -> DataFrame:
    """Stream a log from ``"earliest"``, ``"latest"`` or given offsets, the next to read per partition.

    A partition that the positions do not name is read from its beginning. ``latest`` is what
    the log held when the query first started: it is kept next to the ``checkpoint``, which
    ``latest`` needs, so that what arrives between two runs is read. A checkpoint that has
    batches goes on where it stopped, whatever ``start`` says.
    """
    path = path.rstrip("/")
    number, last = _last_commit(spark, path)
    if number < 0:
        raise ValueError(f"there is no log at {path}")
    if start == "latest":
        if not checkpoint:
            raise ValueError("latest needs the checkpoint of the query that reads")
        start = _first_end(spark, {int(p): o for p, o in last["ends"].items()}, checkpoint)
    positions = {} if start == "earliest" else {str(p): o for p, o in dict(start).items()}
    spark.dataSource.register(OffsetLog)
    return (
        spark.readStream.format(FORMAT).schema(StructType.fromJson(last["schema"])).option("start", json.dumps(positions))
        .option("path", remote.qualified(spark, path)).load()
    )


def _first_end(spark: SparkSession, now: dict[int, int], checkpoint: str) -> dict[int, int]:
    """Where the log ended when the checkpoint was new."""
    kept = f"{checkpoint.rstrip('/')}.start.json"
    text = files.read_text(spark, kept)
    if text is not None:
        return {int(p): o for p, o in json.loads(text).items()}
    if files.exists(spark, checkpoint):
        return {}
    files.write_text(spark, kept, json.dumps(now))
    return now


@dataclass
class Span(InputPartition):
    """Offsets [first, last) of one file of a partition."""

    file: str
    partition: int
    first: int
    last: int


class OffsetReader(DataSourceStreamReader):
    """Plans the files between two positions from the commits."""

    def __init__(self, path: str, start: dict[str, int], schema: StructType):
        self.path, self.start, self.wanted = path, start, schema
        self.seen: dict[int, dict] = {}  # commits that lie behind the start of the last batch are let go

    def _numbers(self) -> list[int]:
        store, root = remote.store(self.path)
        found = store.get_file_info(pafs.FileSelector(f"{root}/{_COMMITS}"))
        return versions.numbers(i.base_name for i in found)

    def _commit(self, number: int) -> dict:
        if number not in self.seen:
            store, root = remote.store(self.path)
            with store.open_input_stream(f"{root}/{_COMMITS}/{versions.name(number)}") as stream:
                self.seen[number] = json.loads(stream.read())
        return self.seen[number]

    def initialOffset(self) -> dict:
        return dict(self.start)

    def latestOffset(self) -> dict:
        numbers = self._numbers()
        now = self._commit(numbers[-1])["ends"] if numbers else {}
        # a start beyond the end of its partition stays where it is
        return {p: max(now.get(p, 0), self.start.get(p, 0)) for p in {*now, *self.start}}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        """Newest commits first, until every partition's start is reached."""
        spans: list[Span] = []
        lacking = {p: start.get(p, 0) for p in end if end[p] > start.get(p, 0)}
        for number in reversed(self._numbers()):
            if not lacking:
                break
            commit = self._commit(number)
            for partition, first, last, name in commit["files"]:
                low, high = start.get(str(partition), 0), end.get(str(partition), 0)
                if first < high and last >= low:
                    spans.append(Span(name, partition, max(first, low), min(last + 1, high)))
                if str(partition) in lacking and first <= lacking[str(partition)]:
                    del lacking[str(partition)]
        return spans or [Span("", 0, 0, 0)]

    def commit(self, end: dict) -> None:
        """What ends before a committed position is not asked for again."""
        self.seen = {n: c for n, c in self.seen.items() if any(c["ends"][p] > end.get(p, 0) for p in c["ends"])}

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        target = to_arrow_schema(self.wanted)
        names = [n for n in target.names if n != "partition"]
        store, root = remote.store(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as raw:
            file = pq.ParquetFile(raw)
            at = file.schema_arrow.get_field_index("offset")
            groups = [g for g in range(file.num_row_groups) if _overlaps(file.metadata.row_group(g).column(at).statistics, partition)]
            for batch in file.iter_batches(row_groups=groups, columns=names, batch_size=10_000):
                offset = batch.column(batch.schema.get_field_index("offset"))
                inside = pc.and_(pc.greater_equal(offset, partition.first), pc.less(offset, partition.last))
                rows = pa.Table.from_batches([batch.filter(inside)])
                rows = rows.append_column("partition", pa.array([partition.partition] * rows.num_rows, pa.int64()))
                yield from rows.select(target.names).cast(target).to_batches()


def _overlaps(statistics, span: Span) -> bool:
    """Whether a row group may hold offsets of the span."""
    return statistics is None or not statistics.has_min_max or statistics.min < span.last and statistics.max >= span.first


class OffsetLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> OffsetReader:
        return OffsetReader(self.options["path"], json.loads(self.options["start"]), schema)
