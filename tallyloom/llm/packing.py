"""Token sequences packed by minimum bin slack.

Every bin is filled by a subset-sum over the lengths still available: the longest
remaining piece goes in first, and a bitset dynamic programme finds the fullest
combination for the rest, which is then removed. What a bin receives depends only on
how many pieces of each length are left, so the same combination is taken as many times
as the counts allow. The plan is made from the histogram of lengths, which has at most
``capacity`` rows whatever the data; the pieces themselves never leave the executors.
They find their place by rank within their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import byte_blocks, durable, packed, small_batches

#: Words of at most so many bytes are remembered, two generations of about so many per task.
_WORD_BYTES, _WORDS = 48, 250_000
#: Marks that may end a word; after an ASCII letter or digit they are tokens of their own.
_MARKS = b".,!?;:"
#: Letters that case folding and normalization leave alone.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: The steps before the model under which a text's ids are those of its words, one after another.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
          "behavior": "Removed", "invert": True}
_tokenizers: dict[str, object] = {}
_by_words: dict[str, bool] = {}
_words: dict[str, tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer and, per id, whether it ends a word."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        vocabulary = made.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _tokenizers[path] = made, last
    return _tokenizers[path]


def by_words(path: str) -> bool:
    """Whether a tokenizer's ids of a text are those of its lower-cased words on end.

    True if it normalizes and splits as stated above and marks ends of words by ``</w>``;
    no other tokenizer is taken apart.
    """
    with open(path, encoding="utf-8") as source:
        told = json.load(source)
    before, split, model = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}, told["model"]
    return (
        before.get("normalizers") == _NORMALIZERS and split.get("type") == "Sequence"
        and split.get("pretokenizers", [None])[0] == _SPLIT and [s["type"] for s in split["pretokenizers"][1:]] == ["ByteLevel"]
        and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and all(t["content"].startswith("<|") for t in told.get("added_tokens", [])))


def _encode_words(words: list[bytes], path: str) -> list[bytes]:
    """Ids of each word; words of plain letters share one text, in which each ends a word."""
    tokenizer, last = _tokenizer(path)
    packed: dict[bytes, bytes] = {}
    plain = [w for w in words if _PLAIN.fullmatch(w)]
    for at in range(0, len(plain), 1000):
        some = plain[at:at + 1000]
        text = b" ".join(some).decode()
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        begin, joined = 0, ids.tobytes()
        for word, end in zip(some, ((np.flatnonzero(last[ids]) + 1) * 4).tolist(), strict=True):
            packed[word] = joined[begin:end]
            begin = end
    other = [w for w in words if w not in packed]
    encoded = tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
    packed.update((w, array("I", e.ids).tobytes()) for w, e in zip(other, encoded, strict=True))
    return [packed[w] for w in words]


def _ids_of(words: list[bytes], path: str) -> list[bytes]:
    """Ids of distinct words, most of them remembered."""
    known, older = _words.get(path, ({}, {}))
    if len(known) > _WORDS:
        known, older = {}, known
    _words[path] = known, older
    ids = list(map(known.get, words))
    if older:
        again = [at for at, x in enumerate(ids) if x is None]
        for at, found in zip(again, map(older.get, map(words.__getitem__, again)), strict=True):
            if found is not None:
                known[words[at]] = ids[at] = found
    missing = [at for at, x in enumerate(ids) if x is None]
    stems = [word.rstrip(_MARKS) if word[-1:] in _MARKS else word for word in (words[at] for at in missing)]
    cut = [stem if stem[-1:].isalnum() else words[at] for stem, at in zip(stems, missing, strict=True)]
    fresh = list({word for word in cut if word not in known}
                 | {words[at][len(stem):] for stem, at in zip(cut, missing, strict=True)})
    found = dict(zip(fresh, _encode_words(fresh, path), strict=True))
    for stem, at in zip(cut, missing, strict=True):
        word = words[at]
        ids[at] = (found.get(stem) or known.get(stem, b"")) + found[word[len(stem):]]
    known.update((w, x) for w, x in found.items() if len(w) <= _WORD_BYTES)
    known.update((words[at], ids[at]) for at in missing if len(words[at]) <= _WORD_BYTES)
    return ids


def encode(texts: pa.Array, path: str) -> Iterator[bytes]:
    """Token ids of each text as little-endian 32-bit numbers.

    Under a tokenizer that works ``by_words`` the ids of a text are those of its lower-cased
    words one after another; only distinct words are looked up, and they are remembered.
    Texts that may hold a special token, and all texts under other tokenizers, are encoded
    as they are.
    """
    if path not in _by_words:
        _by_words[path] = by_words(path)
    if not _by_words[path]:
        for text in texts:
            yield array("I", _tokenizer(path)[0].encode(text.as_py(), add_special_tokens=False).ids).tobytes()
        return
    special = pc.match_substring(texts, "<|")
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", texts)))
    each = words.flatten().dictionary_encode()
    distinct = pa.array(_ids_of(each.dictionary.cast(pa.binary()).to_pylist(), path), pa.large_binary())
    ids = distinct.take(each.indices)
    data, ends = packed(ids) if len(ids) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    ends = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(int)]
    for row, whole in enumerate(special.to_pylist()):
        if whole:
            tokens = _tokenizer(path)[0].encode(texts[row].as_py(), add_special_tokens=False)
            yield array("I", tokens.ids).tobytes()
        else:
            yield data[ends[row]:ends[row + 1]].tobytes()


def _cut(path: str, capacity: int, end: int, ids: bool) -> Callable:
    """Task side of tokenizing: the pieces of each document."""
    last, width = array("I", [end]).tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_blocks(whole, 1, 1 << 23):
                rows, numbers, starts, lengths, sums, bodies = [], [], [], [], [], []
                for row, tokens in enumerate(encode(batch.column(1), path)):
                    tokens += last
                    for number, start in enumerate(range(0, len(tokens), width)):
                        piece = tokens[start:start + width]
                        rows.append(row)
                        numbers.append(number)
                        starts.append(start // 4)
                        lengths.append(len(piece) // 4)
                        sums.append(zlib.crc32(piece))
                        if ids:
                            bodies.append(np.frombuffer(piece, np.uint32).astype(np.int32))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()),
                           pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    columns.append(pa.array(bodies, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        _words.clear()  # the worker goes on to other tasks, some of them of other operators
    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, ids: bool = False,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as token pieces of at most ``capacity``, each document closed by the id ``end``.

    Returns doc_id, piece, start, length, ids_crc32, and with ``ids`` the token ids.
    A null or empty text is the single id ``end``. Each row of ``docs`` is cut for itself.
    """
    small_batches(docs.sparkSession)
    out = T.StructType([
        T.StructField("doc_id", docs.schema[key].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType())])
    if ids:
        out.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(_cut(tokenizer, capacity, end, ids), out)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that fills ``room`` best, by bitset subset sums.

    Bit s of the set says that s can be reached. Long lengths are tried first and kept
    where the sum allows it.
    """
    mask = (1 << (room + 1)) - 1
    reach, before = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        before.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(step, left)
            reach |= reach << take * length & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, smaller in reversed(before):
        n = 0
        while not smaller >> total & 1:
            total -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


#: (length, first rank, pieces of it per bin, first bin, place of the first of them in the bin)
Run = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Ranges of ranks for every length, and the number of bins."""
    left, used = dict(histogram), dict.fromkeys(histogram, 0)
    runs: list[Run] = []
    bins = 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[length] // n for length, n in chosen.items())
        place = 0
        for length, n in sorted(chosen.items(), reverse=True):
            runs.append((length, used[length], n, bins, place))
            place += n * length
            used[length] += times * n
            left[length] -= times * n
            if not left[length]:
                del left[length]
        bins += times
    return runs, bins


def _place(shared) -> Callable:
    """Task side: sequence and offset of each (length, rank)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, table = shared.value
        for rows in batches:
            length, rank = rows["length"].to_numpy(), rows["_rank"].to_numpy()
            at = np.searchsorted(starts, (length << 48) + rank, side="right") - 1
            _, first, n, bins, place = table[:, at]
            behind = rank - first
            rows["sequence_id"] = bins + behind // n
            rows["offset"] = place + behind % n * length
            yield rows.drop(columns="_rank")
    return run


def pack(cut: DataFrame, capacity: int = 2048, slices: int = 4096) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of ``cut``, which needs doc_id, piece, ids_crc32, length.

    Sequences hold at most ``capacity`` and are gapless from 0. Rows of one length are
    numbered in ``slices`` pieces, so that no task sorts all of them. Equal rows may swap
    places with each other. An empty table gives no rows.
    """
    spark = cut.sparkSession
    sliced = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    counts = durable(sliced.groupBy("length", "_slice").agg(F.count("*").alias("n")), "pack_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if histogram and max(histogram) > capacity:
        raise ValueError(f"a piece is longer than {capacity}")
    runs, _ = plan(histogram, capacity)
    table = np.array(sorted(runs) or [(0, 0, 1, 0, 0)], np.int64).T
    shared = spark.sparkContext.broadcast(((table[0] << 48) + table[1], table))
    before = counts.select("length", "_slice", (
        F.sum("n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("n")).alias("_before"))
    within = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        sliced.withColumn("_within", F.row_number().over(within) - 1).join(before, ["length", "_slice"])
        .withColumn("_rank", (F.col("_before") + F.col("_within")).cast("long"))
        .select(*cut.columns, "_rank")
    )
    out = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInPandas(_place(shared), out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack: one row per piece (see ``pieces`` and ``pack``)."""
    cut = pieces(docs, tokenizer, capacity, end, key=key, text=text)
    return pack(durable(cut, "pack_pieces"), capacity).withColumnRenamed("doc_id", key)
