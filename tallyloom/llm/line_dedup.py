"""Lines that repeat across documents, found by Bloom filters and confirmed exactly.

Three passes over the text, none of which shuffles ordinary lines:

1. every task fills two Bloom filters, one for hashes seen once and one for hashes seen
   twice. Merging two tasks ORs both filters and adds to the second whatever both first
   filters hold, so the merged second filter has every key that occurs twice anywhere;
2. lines whose hash is in the second filter are suspects. Only they are shuffled, under
   an exact 256-bit digest, to find the keys that really occur in two documents and the
   smallest document of each;
3. each document drops the lines the second pass has convicted.

Filters of tasks are merged in a tree. They have 16 bits per line up to
``max_filter_bits``, which bounds what is sent to the tasks. Beyond that more lines become
suspects; the result stays exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import BLANKS, durable, small_batches, unused, utf8

#: Bits of one piece of a filter; pieces are merged apart.
PIECE_BITS = 1 << 19
_HELD = 1 << 20


def keys_of(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text and the key of each: stripped of ASCII blanks, A-Z in lower case."""
    lines = text.split(b"\n")
    return lines, [line.strip(BLANKS).lower() for line in lines]


def long_enough(key: bytes, least: int) -> bool:
    """At least ``least`` code points; a code point has one to four bytes."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions of each 64-bit hash."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask])


def _pieces(bitmap: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Filled pieces of a bitmap, as positions where these are shorter."""
    width = min(PIECE_BITS, bitmap.size * 8) // 8
    for piece in range(bitmap.size // width):
        part = bitmap[piece * width:(piece + 1) * width]
        if not part.any():
            continue
        held = np.flatnonzero(np.unpackbits(part, bitorder="little")).astype(np.uint32)
        yield piece, (b"p" + held.tobytes() if held.nbytes < part.nbytes else b"b" + part.tobytes())


def _bitmap(packed: bytes | None, width: int) -> np.ndarray:
    if not packed:
        return np.zeros(width, np.uint8)
    if packed[:1] == b"b":
        return np.frombuffer(packed[1:], np.uint8)
    bits = np.zeros(width * 8, np.uint8)
    bits[np.frombuffer(packed[1:], np.uint32)] = 1
    return np.packbits(bits, bitorder="little")


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = np.unique(at)
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64),
                     np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def _held(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1


#: Filters of how many tasks are merged at a time.
FAN = 64


def _fill(bits: int, least: int) -> Callable:
    """Task side of pass 1: pieces of this task's two filters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

        def add(hashes: list[int]) -> None:
            values, n = np.unique(np.array(hashes, np.uint64), return_counts=True)
            at = positions(values, bits)
            again = (n > 1) | _held(once, at).all(axis=0)
            _set(twice, at[:, again].ravel())
            _set(once, at.ravel())

        hashes: list[int] = []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes += {xxhash.xxh3_64_intdigest(k) for k in set(keys_of(text)[1]) if long_enough(k, least)}
                if len(hashes) >= _HELD:
                    add(hashes)
                    hashes = []
        add(hashes)
        again = dict(_pieces(twice))
        for piece, packed in _pieces(once):
            yield pa.RecordBatch.from_pydict({
                "piece": pa.array([piece], pa.int32()), "part": pa.array([part], pa.int32()),
                "once": pa.array([packed], pa.binary()),
                "twice": pa.array([again.get(piece)], pa.binary())})
    return run


_FILTERS = "piece int, part int, once binary, twice binary"


def merged(filled: DataFrame, parts: int, width: int) -> DataFrame:
    """The second filter of each piece, of those of about ``parts`` tasks.

    They are merged ``FAN`` at a time, so that no group grows with the number of tasks.
    """
    while parts > FAN:
        parts = -(-parts // FAN)
        filled = filled.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("piece", "part").applyInArrow(
            _meet(width), _FILTERS)
    return filled.groupBy("piece").applyInArrow(_merge(width), "piece int, twice binary")


def _joined(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filters of several pairs of them."""
    once, twice = np.zeros(width, np.uint8), np.zeros(width, np.uint8)
    for own, again in zip(table.column("once"), table.column("twice"), strict=True):
        own = _bitmap(own.as_py(), width)
        twice |= _bitmap(again.as_py(), width) | (once & own)
        once |= own
    return once, twice


def _meet(width: int) -> Callable:
    """Some tasks' filters of a piece become one task's."""
    def run(table: pa.Table) -> pa.Table:
        packed = [pa.array([b"b" + bitmap.tobytes()], pa.binary()) for bitmap in _joined(table, width)]
        return pa.table([table.column("piece")[:1], table.column("part")[:1], *packed], ["piece", "part", "once", "twice"])
    return run


def _merge(width: int) -> Callable:
    """The second filter of a piece."""
    def run(table: pa.Table) -> pa.Table:
        twice = _joined(table, width)[1]
        return pa.table({"piece": table.column("piece")[:1], "twice": pa.array([twice.tobytes()], pa.binary())})
    return run


def _suspects(shared, bits: int, least: int) -> Callable:
    """Task side of pass 2: digest and document of every line the second filter holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            keys: list[bytes] = []
            rows: list[int] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = [k for k in set(keys_of(text)[1]) if long_enough(k, least)]
                keys += own
                rows += [row] * len(own)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
            hit = np.flatnonzero(_held(twice, positions(hashes, bits)).all(axis=0))
            digests = [hashlib.sha256(keys[i]).digest() for i in hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), batch.column(0).take(pa.array([rows[i] for i in hit], pa.int64()))],
                ["_key", "_doc"])
    return run


def _drop(text: str, marks: str, kept: list[str], least: int) -> Callable:
    """Task side of pass 3: texts without the convicted lines, and the counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for body, gone in zip(batch.column(text).to_pylist(), batch.column(marks).to_pylist(), strict=True):
                if not gone:
                    texts.append(body)
                    total.append(body.count("\n") + 1)
                    dropped.append(0)
                    continue
                lines, keys = keys_of(body.encode())
                convicted = set(gone)
                stay = [line for line, key in zip(lines, keys, strict=True)
                        if not (long_enough(key, least) and hashlib.sha256(key).digest() in convicted)]
                texts.append(b"\n".join(stay).decode())
                total.append(len(lines))
                dropped.append(len(lines) - len(stay))
            new = {text: pa.array(texts, pa.string()), "n_lines": pa.array(total, pa.int64()),
                   "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, None) if c in new else batch.column(c) for c in kept], kept)
    return run


def dedup_lines(docs: DataFrame, least: int = 10, max_filter_bits: int = 1 << 29,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without lines that an earlier document holds.

    A line's key is the line stripped of ASCII blanks and with A-Z in lower case. A key of
    at least ``least`` code points found in at least two documents loses its lines
    everywhere but in the smallest document id. Returns all columns with the text
    replaced, and ``n_lines`` (before dropping) and ``n_dropped``, which replace columns
    of these names.

    A null text counts as one empty line and becomes the empty text; a document may end
    up empty and stays. Rows with one id are one document. Rows without an id neither
    lose lines nor make others lose theirs. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    lines = docs.agg(F.sum((F.length(body) - F.length(F.replace(body, F.lit("\n"))) + 1)).alias("n")).first()["n"] or 0
    bits = 1 << max(13, min((16 * lines - 1).bit_length(), max_filter_bits.bit_length() - 1))
    width = min(PIECE_BITS, bits) // 8
    known = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_doc"), utf8(text).alias("_text"))
    filled = known.select("_text").mapInArrow(_fill(bits, least), _FILTERS)
    whole = merged(filled, known.rdd.getNumPartitions(), width)
    second = bytearray(bits // 8)
    for row in whole.toLocalIterator():  # pieces of a filter of bounded size
        second[row["piece"] * width:(row["piece"] + 1) * width] = row["twice"]
    shared = spark.sparkContext.broadcast(bytes(second))
    kind = docs.schema[key].dataType
    suspects = durable(
        known.mapInArrow(_suspects(shared, bits, least),
                         T.StructType([T.StructField("_key", T.BinaryType()), T.StructField("_doc", kind)])),
        "line_suspects")
    repeats = durable(
        suspects.groupBy("_key").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"))
        .filter("_first <> _last").select("_key", "_first"), "line_repeats")
    marks = unused(docs.columns, "_marks")
    doc = unused(docs.columns, "_doc_of_mark")
    convicted = (
        suspects.join(repeats, "_key").filter("_doc <> _first")
        .groupBy(F.col("_doc").alias(doc)).agg(F.collect_set("_key").alias(marks))
    )
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    marked = docs.select(*[body.alias(c) if c == text else F.col(f"`{c}`") for c in kept]).join(
        convicted, F.col(key) == F.col(doc), "left").drop(doc)
    out = T.StructType([f for f in docs.schema if f.name in kept]
                       + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return marked.mapInArrow(_drop(text, marks, [f.name for f in out], least), out)
