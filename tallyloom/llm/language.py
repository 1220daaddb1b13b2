"""Language identification by a bit-sliced Bloom filter of character n-grams.

One filter answers for all languages: every position holds a bitmask with one bit per
language, and an n-gram's mask is the AND of the masks at its positions, that is all
languages that contain it. A text's n-grams vote with their bits; the count of each
language is corrected for the filter's false positives, and the largest decides.

An n-gram belongs to the languages in which a share of the sampled documents has it, and
which have it not much more rarely than the language that has it most often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import byte_blocks, durable, mix, small_batches, utf8

GRAM = 3
_WINDOW = 1 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point its lower-case letter, 0 if it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of the joined texts: hashes of trigrams around each letter, where each text begins in them.

    A trigram is a letter with its neighbours; whatever is no letter counts as one blank.
    """
    table = letters()
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    joined = "\0".join(texts) + "\0"
    for begin in range(0, len(joined), _WINDOW):
        end = min(begin + _WINDOW, len(joined))
        left, right = max(begin - 1, 0), min(end + 1, len(joined))
        codes = np.frombuffer(joined[left:right].encode("utf-32-le", "surrogatepass"), np.uint32)
        padded = np.zeros(end - begin + 2, np.uint64)
        padded[1 - (begin - left):1 - (begin - left) + len(codes)] = table[codes]
        middle = np.flatnonzero(padded[1:-1])
        hashes = mix(padded[middle] * np.uint64(0xA24BAED4963EE407) + padded[middle + 1] * np.uint64(0x9FB21C651E98DF25)
                     + padded[middle + 2] * np.uint64(0xC13FA9A902A6328F))
        yield hashes, np.searchsorted(middle + begin, np.concatenate([[0], ends]))


@dataclass
class Model:
    """Languages in alphabetical order and, per 64 of them, the mask at each position."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    fallback: int

    @classmethod
    def build(cls, members: dict[str, np.ndarray], documents: dict[str, int], bits: int = 18) -> Model:
        languages = sorted(members)
        masks = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64)
        for at, language in enumerate(languages):
            for position in _positions(members[language], bits):
                masks[at // 64, np.unique(position)] |= np.uint64(1 << at % 64)
        full = [((masks[at // 64] >> np.uint64(at % 64)) & np.uint64(1)).mean() for at in range(len(languages))]
        fallback = max(range(len(languages)), key=lambda i: (documents[languages[i]], -i), default=0)
        return cls(languages, masks, np.array(full) ** 2, fallback)

    def votes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected counts per text and language, letters per text)."""
        bits = int(self.masks.shape[1]).bit_length() - 1
        counts, letters_of = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for hashes, edges in grams(texts):
            first, second = _positions(hashes, bits)
            letters_of += np.diff(edges)
            for at in range(len(self.languages)):
                table = self.masks[at // 64]
                if at % 64 == 0:
                    found = table[first] & table[second]
                total = np.concatenate([[0], np.cumsum((found >> np.uint64(at % 64)) & np.uint64(1), dtype=np.int64)])
                counts[:, at] += total[edges[1:]] - total[edges[:-1]]
        missed = letters_of[:, None] * self.false_rate
        return np.maximum(counts - missed, 0) / (1 - np.minimum(self.false_rate, 0.999)), letters_of

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        votes, letters_of = self.votes(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best, total = votes.argmax(axis=1), votes.sum(axis=1)
        best[total == 0] = self.fallback
        top = votes[np.arange(len(texts)), best]
        score = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
        return ([self.languages[b] if n else "und" for b, n in zip(best, letters_of, strict=True)],
                np.where(letters_of > 0, score, 0.0))


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per (language, n-gram) of a task."""
    held: dict[str, dict[int, int]] = {}
    for whole in batches:
        for batch in byte_blocks(whole, 1):
            languages = batch.column(0).to_pylist()
            parts: dict[str, list[np.ndarray]] = {}
            for language, text in zip(languages, batch.column(1).to_pylist(), strict=True):
                own = [np.unique(h) for h, _ in grams([text.decode("utf-8", "replace")])]
                parts.setdefault(language, []).append(np.unique(np.concatenate(own)))
            for language, all_of in parts.items():
                values, times = np.unique(np.concatenate(all_of), return_counts=True)
                known = held.setdefault(language, {})
                for gram, n in zip(values.astype(np.int64).tolist(), times.tolist(), strict=True):
                    known[gram] = known.get(gram, 0) + n
            if sum(map(len, held.values())) > 1_000_000:
                yield from _flush(held)
                held = {}
    yield from _flush(held)


def _flush(held: dict[str, dict[int, int]]) -> Iterator[pa.RecordBatch]:
    for language, known in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([language] * len(known), pa.string()), pa.array(list(known), pa.int64()),
             pa.array(list(known.values()), pa.int64())], ["lang", "gram", "n"])


def learn(docs: DataFrame, per_language: int = 2000, most_languages: int = 10_000, least_share: float = 0.01, least_ratio: float = 0.3,
          bits: int = 18, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Model of the languages of ``docs``; pass learners only. Rows without language or text are ignored.

    About ``per_language`` documents of each language learn, by a hash of the key; their
    texts are read whole. An n-gram belongs to a language if at least ``least_share`` of
    its documents have it, and at least ``least_ratio`` of the share it has in any language.
    At most (mean distinct n-grams per document) / ``least_share`` n-grams of a language
    can pass, which bounds what reaches the driver. More than ``most_languages`` values of
    ``lang`` are an error: a column with so many holds something else.
    """
    small_batches(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("_text"))
    rows = durable(known.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    if rows.count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    many = {r["lang"]: r["rows"] for r in rows.collect()}
    if not many:
        return Model.build({}, {}, bits)
    share = F.lit(float(per_language)) / F.col("rows")
    chosen = known.join(F.broadcast(rows), "lang").filter(
        F.pmod(F.xxhash64("_key", F.lit("language")), F.lit(1 << 30)) < share * (1 << 30))
    sampled = chosen.select("lang", utf8("_text").alias("_text"))
    counts = sampled.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = chosen.groupBy("lang").agg(F.count("*").alias("docs"))
    shares = counts.join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("docs"))
    common = shares.filter(F.col("share") >= least_share).collect()
    top: dict[int, float] = {}
    for r in common:
        top[r["gram"]] = max(top.get(r["gram"], 0.0), r["share"])
    members: dict[str, list[int]] = {language: [] for language in many}
    for r in common:
        if r["share"] >= least_ratio * top[r["gram"]]:
            members[r["lang"]].append(r["gram"])
    return Model.build({k: np.array(v, np.int64).astype(np.uint64) for k, v in members.items()}, many, bits)


def _predict(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in byte_blocks(whole, whole.num_columns - 1):
                texts = [t.decode("utf-8", "replace") for t in batch.column(batch.num_columns - 1).to_pylist()]
                names, score = model.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    [*batch.schema.names[:-1], "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns plus ``lang_pred`` and ``score`` (the language's part of all votes), replacing columns so named.

    A text that is null or has no letter is ``und`` with score 0; so is every text under a
    model without languages. A text none of whose n-grams is known gets the language with
    most learners and score 0; equal votes go to the alphabetically first language. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name.lower() not in ("lang_pred", "score")]
    out = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], utf8(text).alias("_body_of_text")).mapInArrow(
        _predict(shared), out)
