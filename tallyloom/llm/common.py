"""Helpers the operators share: durable tables, packed text columns, stable learning folds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: ASCII white space, the only white space the contracts name.
BLANKS = b" \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Hand texts to Python in batches of so many bytes, however many rows these are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, parts: int) -> Column:
    """Stable remainder of a key: crc32 of its text, modulo ``parts``. A null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % parts


def utf8(text: str) -> Column:
    """Text as UTF-8 bytes, null as no bytes: Python then gets bytes without decoding."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values on end, offsets of each value) of an Arrow binary column without copying."""
    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit hashes (two rounds of xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def unused(columns: Iterable[str], name: str) -> str:
    """A column name near ``name`` that none of ``columns`` has, letter case aside."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Odd multiplier of the word hash, and how many bytes one piece of a text may have.
_PRIME, _PIECE = 0x9E3779B97F4A7C15 | 1, 1 << 20
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, lower case plus one, blanks."""
    if not _tables:
        for name, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
            powers = np.full(_PIECE, base, np.uint64)
            powers[0] = 1
            _tables[name] = np.cumprod(powers, dtype=np.uint64)
        low = np.frombuffer(bytes(range(256)).lower(), np.uint8)
        _tables["low"] = low.astype(np.uint64) + np.uint64(1)
        blank = np.zeros(256, bool)
        blank[list(BLANKS)] = True
        _tables["blank"] = blank
    return _tables["up"], _tables["down"], _tables["low"], _tables["blank"]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, number of words before each text and in all).

    Words are runs of bytes that are no ASCII blank; A-Z counts as a-z. Texts are pieces
    of ``raw`` between ``offsets`` and are hashed together, a megabyte at a time.
    """
    up, down, low, blanks = _powers()
    base, end = int(offsets[0]), int(offsets[-1])
    bounds = np.unique(offsets)
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = base
    while at < end:
        stop = min(end, at + _PIECE)
        data = raw[at:stop]
        if stop < end:
            # cut behind the last blank or text end; a word longer than a piece is hashed alone
            cut = np.flatnonzero(blanks[data[-65536:]])
            edge = bounds[np.searchsorted(bounds, stop, side="right") - 1] - at
            size = max(len(data) - min(65536, len(data)) + int(cut[-1]) + 1 if len(cut) else 0, int(edge))
            if size <= 0:
                cut = np.flatnonzero(blanks[data])
                size = int(cut[-1]) + 1 if len(cut) else 0
            if not size:
                stop = int(bounds[np.searchsorted(bounds, at, side="right")])
                for far in range(at, stop, _PIECE):
                    cut = np.flatnonzero(blanks[raw[far:min(far + _PIECE, stop)]])
                    if len(cut):
                        stop = far + int(cut[0])
                        break
                hashes.append(np.array([xxhash.xxh3_64_intdigest(raw[at:stop].tobytes().lower())], np.uint64))
                begins.append(np.array([at], np.int64))
                at = stop
                continue
            stop = at + size
            data = raw[at:stop]
        word = ~blanks[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        edges = bounds[(bounds > at) & (bounds < stop)] - at
        first[edges] = word[edges]
        last = word.copy()
        last[:-1] &= first[1:] | ~word[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        total = np.cumsum(low[data] * up[:len(data)], dtype=np.uint64)
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        if len(starts) == 1 and ends[0] - starts[0] + 1 == _PIECE:
            # a word as long as a piece counts as longer than one, whatever comes behind it
            hashes.append(np.array([xxhash.xxh3_64_intdigest(data.tobytes().lower())], np.uint64))
        else:
            hashes.append(mix((total[ends] - before) * down[starts]))
        begins.append(starts + at)
        at = stop
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(begin, offsets)


def byte_blocks(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a column; a longer value is a slice alone."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
