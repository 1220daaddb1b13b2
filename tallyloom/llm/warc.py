"""WARC archives as a Spark data source, and page captures with revisit records.

``spark.read.format("warc")`` plans partitions from files, takes predicates on the record
type and other headers, parses the headers of a record first and does not inflate the
rest of a record that the predicates reject or whose payload the schema leaves out.
``df.write.format("warc")`` writes one gzip member per record. A member carries its own
length in the gzip extra field ``sl``, so a reader can skip it without inflating it;
members of other writers are inflated to find their end, and plain ``.warc`` files are
skipped by Content-Length.

A write becomes visible by one manifest, written when every task is done: files of failed
attempts are in no manifest and are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
    StringStartsWith, WriterCommitMessage,
)

from ..sources import remote
from .common import durable, small_batches, utf8

SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, "
          "payload_bytes long, refers_to string, headers map<string,string>, payload binary")
#: Column of a record and the header it comes from.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
           "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length",
           "refers_to": "WARC-Refers-To"}
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILE_BYTES, _PART_BYTES, _BATCH_BYTES = 256 << 20, 64 << 20, 16 << 20
_HEAD = 1 << 12


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes | None, sha1: str, length: int,
           refers_to: str | None) -> bytes:
    """A WARC/1.1 record; without a payload the block is the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date),
              ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", str(length)),
              ("WARC-Refers-To", refers_to), ("WARC-Profile", _SAME_PAYLOAD if kind == "revisit" else None),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    for bad in "\r\n\0":
        value = value.replace(bad, f"%{ord(bad):02X}")
    return value


def member(body: bytes) -> bytes:
    """One gzip member whose extra field tells its own length and that of its body."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    deflated = squeeze.compress(body) + squeeze.flush()
    total = 10 + 2 + 20 + len(deflated) + 8
    extra = b"sl" + struct.pack("<HQQ", 16, total, len(body))
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + deflated + struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)


def _told_length(head: bytes) -> int | None:
    """Length of a gzip member from its ``sl`` field, if it has one."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at:at + 2] == b"sl" and size == 16:
            return struct.unpack_from("<Q", head, at + 4)[0]
        at += 4 + size
    return None


def _parse(head: bytes) -> dict[str, str]:
    """Header fields; names are matched without letter case."""
    found: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip()
            found[last] = value.strip()
    return found


class _Wanted:
    """Decides on a record by its headers alone."""

    def __init__(self, tests: list[tuple[str, str, object]]):
        self.tests = tests

    def __call__(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            have = row.get(column)
            if have is None:
                return False
            if kind == "in" and have not in value or kind == "starts" and not have.startswith(value):
                return False
        return True


def _columns(headers: dict[str, str]) -> dict:
    lower = {k.lower(): v for k, v in headers.items()}
    row = {c: lower.get(h.lower()) for c, h in HEADERS.items()}
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    row["payload_bytes"] = int(row["payload_bytes"]) if (row["payload_bytes"] or "").isdigit() else None
    row["headers"] = headers
    return row


def _payload(block: bytes, row: dict) -> bytes | None:
    """What follows the HTTP head of a response; null for a revisit, the block of other records."""
    if row["record_type"] == "revisit":
        return None
    if row["record_type"] == "response" and block.startswith(b"HTTP/"):
        block = block.split(b"\r\n\r\n", 1)[-1]
    if row["payload_digest"] and row["payload_digest"] != digest(block):
        raise ValueError(f"payload digest of {row['record_id']} does not match")
    return block


def records(source: io.BufferedReader, zipped: bool, wanted: _Wanted, payloads: bool) -> Iterator[dict]:
    """Wanted records of one archive file. Nothing behind the headers is decoded unless needed."""
    start = 0
    while True:
        source.seek(start)
        raw = source.read(_HEAD)
        if not raw.strip(b"\r\n"):
            return
        if not zipped:
            skip = len(raw) - len(raw.lstrip(b"\r\n"))
            start, raw = start + skip, raw[skip:]
        inflate = zlib.decompressobj(zlib.MAX_WBITS | 16) if zipped else None
        body, read = b"", len(raw)
        while True:
            body += inflate.decompress(raw, _HEAD if zipped else 0) if zipped else raw
            if b"\r\n\r\n" in body:
                break
            raw = (inflate.unconsumed_tail if zipped else b"") or source.read(_HEAD)
            if not raw:
                raise ValueError("a record ends within its headers")
        head, block = body.split(b"\r\n\r\n", 1)
        row = _columns(_parse(head))
        size = int({k.lower(): v for k, v in row["headers"].items()}.get("content-length", 0))
        take = wanted(row)
        told = None
        if zipped:
            source.seek(start)
            told = _told_length(source.read(_HEAD))
        needed = take and payloads
        if needed or zipped and told is None:
            if zipped:
                source.seek(start)
                inflate, parts, read = zlib.decompressobj(zlib.MAX_WBITS | 16), [], 0
                while not inflate.eof:
                    raw = source.read(1 << 16)
                    if not raw:
                        raise ValueError("a gzip member is cut off")
                    read += len(raw)
                    out = inflate.decompress(raw)
                    if needed:
                        parts.append(out)
                told = told or read - len(inflate.unused_data)
                block = b"".join(parts)[len(head) + 4:] if needed else b""
            else:
                source.seek(start + len(head) + 4)
                block = source.read(size)
        if take:
            row["payload"] = _payload(block[:size], row) if payloads else None
            yield row
        start += told if zipped else len(head) + 4 + size


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """A path without a scheme is one of this machine; ``archive`` and ``read_pages`` ask Spark for its scheme."""
    if ":/" not in path:
        return pafs.LocalFileSystem(), path
    return remote.store(path)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, lists and prefixes on header columns are decided here, others by Spark."""
        for test in filters:
            column = test.attribute[0] if hasattr(test, "attribute") and len(test.attribute) == 1 else None
            if column not in HEADERS:
                yield test
            elif isinstance(test, EqualTo):
                self.tests.append((column, "in", (test.value,)))
            elif isinstance(test, In):
                self.tests.append((column, "in", tuple(test.value)))
            elif isinstance(test, StringStartsWith):
                self.tests.append((column, "starts", test.value))
            elif isinstance(test, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        """Files, small ones together. With manifests only the files these name count."""
        store, root = _open(self.path)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        if not found and store.get_file_info(root).type == pafs.FileType.File:
            found = [store.get_file_info(root)]
        named = {name for info in found if info.base_name.startswith("_manifest-")
                 for name in json.loads(store.open_input_stream(info.path).read())}
        files = [i for i in found if i.base_name.endswith((".warc", ".warc.gz")) and (not named or i.base_name in named)]
        parts: list[list[str]] = [[]]
        size = 0
        for info in sorted(files, key=lambda i: i.path):
            if size + info.size > _PART_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(info.path)
            size += info.size
        return [InputPartition(paths) for paths in parts if paths] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        names = [f.name for f in self.schema]
        wanted, kinds = _Wanted(self.tests), [_ARROW[name] for name in names]
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], kind)
                       for n, kind in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for path in partition.value:
            with store.open_input_file(path) as raw:
                source = io.BufferedReader(raw, 1 << 16)
                for row in records(source, path.endswith(".gz"), wanted, "payload" in names):
                    rows.append(row)
                    held += 400 + len(row["payload"] or b"")
                    if held >= _BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


_ARROW = {name: pa.string() for name in HEADERS} | {
    "payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Columns used: record_type, record_id, target_uri, refers_to, payload, payload_bytes, payload_digest.

    ``payload_bytes`` and ``payload_digest`` are worked out where they are null or missing.
    """

    def __init__(self, path: str, date: str, overwrite: bool):
        self.path, self.date, self.overwrite = path, date, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        names: list[str] = []
        sink, size = None, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if sink is None or size >= _FILE_BYTES:
                        if sink:
                            sink.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        sink, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    payload = row.get("payload")
                    length, sha1 = row.get("payload_bytes"), row.get("payload_digest")
                    body = member(record(
                        row["record_type"], row["record_id"], row.get("target_uri"), self.date, payload,
                        digest(payload or b"") if sha1 is None else sha1,
                        len(payload or b"") if length is None else length, row.get("refers_to")))
                    sink.write(body)
                    size += len(body)
        finally:
            if sink:
                sink.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        old = [i for i in store.get_file_info(pafs.FileSelector(root)) if i.base_name.startswith("_manifest-")]
        names = [name for message in messages if message for name in message.names]
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())
        if self.overwrite:
            for info in old:
                gone = json.loads(store.open_input_stream(info.path).read())
                store.delete_file(info.path)
                for name in gone:
                    store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = _open(self.path)
        for name in [name for message in messages if message for name in message.names]:
            store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Options: ``path``; when writing ``date``, the WARC-Date of all records."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known and let predicates reach it."""
    small_batches(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def captures(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", uri: str = "url",
             body: str = "html") -> DataFrame:
    """Records to archive: one response for equal payloads, revisits for the others.

    Of rows with equal payloads of at least ``least_bytes`` that with the largest key is the
    response; the others are revisits without payload that refer to it. A null body is the
    empty payload. Repeated rows of the largest key are all responses. A row without a key
    is a revisit if another row with a key has its payload, else a response. An empty table
    gives no rows, and further columns are ignored.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(uri).cast("string").alias("target_uri"), utf8(body).alias("_body"))
    rows = rows.withColumn("_sha1", F.sha1("_body")).withColumn("payload_bytes", F.octet_length("_body").cast("long"))
    keepers = durable(
        rows.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("_sha1", "payload_bytes").agg(F.max("_key").alias("_keeper"), F.count("*").alias("_n"))
        .filter("_n > 1 AND _keeper IS NOT NULL").drop("_n"), "warc_keepers")
    again = F.col("_keeper").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_keeper"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return rows.join(keepers, ["_sha1", "payload_bytes"], "left").select(
        name(F.col("_key")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.when(again, name(F.col("_keeper"))).alias("refers_to"), "payload_bytes",
        _base32(F.col("_sha1")).alias("payload_digest"), F.when(~again, F.col("_body")).alias("payload"))


def _base32(sha1: Column) -> Column:
    """Base32 of 40 hex digits, twenty bits at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for at in range(8):
        bits = F.conv(F.substring(sha1, 5 * at + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(bits, by).bitwiseAND(31) + 1, F.lit(1)) for by in (15, 10, 5, 0)]
    return F.concat(*out)


def archive(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id") -> None:
    """Write the captures of ``pages`` as archives below ``path``."""
    spark = pages.sparkSession
    register(spark)
    captures(pages, least_bytes, key).write.format("warc").mode("append").save(remote.qualified(spark, path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say about each page. Payloads of responses are inflated and held against their digest."""
    register(spark)
    path = remote.qualified(spark, path)
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    columns = "record_id string, record_type string, payload_digest string, refers_to string"
    read = lambda more: spark.read.format("warc").schema(f"{columns}, {more}").load(path)
    full = read("payload binary").filter("record_type = 'response'").withColumn(
        "payload_bytes", F.octet_length("payload").cast("long")).drop("payload")
    heads = read("payload_bytes long").filter("record_type = 'revisit'")
    return full.unionByName(heads).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page(F.col("refers_to")).alias("refers_to"))
