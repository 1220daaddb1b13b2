"""Document quality by Bradley-Terry ranking.

Features of the whole text give a document a linear strength. The strengths are fitted to
preference pairs, a document labelled good against one labelled bad, by logistic loss on
the difference of their features. The cut between good and bad is a quantile of the
learners' strengths, and the score is a logistic curve through that cut.

The fit uses at most about ``per_label`` learners of each label, chosen by a hash of the
document id; that many rows of features reach the driver whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import byte_blocks, packed, small_batches, utf8, word_hashes

#: Kinds of bytes a text is counted by.
KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "blank": b" \t\x0b\x0c\r", "line": b"\n", "end": b".!?", "pause": b",;:", "bar": b"|",
    "mark": b"#$%&*@^~=+<>{}[]\\_/`", "quote": b"'\"()-", "wide": bytes(range(128, 256)),
}
NAMES = [f"share_{kind}" for kind in KINDS] + [
    "log_words", "word_bytes", "distinct", "repeat", "repeat_two", "most_common", "words_per_end", "words_per_line",
    "few_words", "any_mark", "any_bar"]


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text, columns ``NAMES``; all zero for a text without words."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    counts = np.zeros((len(KINDS), n))
    for at, kind in enumerate(KINDS.values()):
        table = np.zeros(256, np.uint8)
        table[list(kind)] = 1
        for begin in range(int(offsets[0]), int(offsets[-1]), 1 << 20):
            end = min(begin + (1 << 20), int(offsets[-1]))
            total = np.concatenate([[0], np.cumsum(table[raw[begin:end]], dtype=np.int64)])
            inside = np.clip(offsets, begin, end) - begin
            counts[at] += total[inside[1:]] - total[inside[:-1]]
    hashes, words = word_hashes(raw, offsets)
    each = np.diff(words).astype(float)
    distinct, common = np.zeros(n), np.zeros(n)
    for row in range(n):
        if each[row]:
            _, times = np.unique(hashes[words[row]:words[row + 1]], return_counts=True)
            distinct[row], common[row] = len(times), times.max()
    some = np.maximum(each, 1)

    def equal(by: int) -> np.ndarray:
        same = np.concatenate([[0], np.cumsum(hashes[by:] == hashes[:-by])]) if len(hashes) > by else np.zeros(1)
        return np.where(each > by, same[np.clip(words[1:] - by, 0, len(same) - 1)] - same[np.clip(words[:-1], 0, len(same) - 1)], 0)

    by = dict(zip(KINDS, counts, strict=True))
    columns = [c / np.maximum(size, 1) for c in counts] + [
        np.log1p(each), (size - by["blank"] - by["line"]) / some, distinct / some, equal(1) / some, equal(2) / some,
        common / some, np.log1p(each / (1 + by["end"])), np.log1p(each / (1 + by["line"])), each < 20,
        np.log1p(by["mark"]), np.log1p(by["bar"])]
    return np.where(each[:, None] > 0, np.stack(columns, axis=1).astype(float), 0.0)


@dataclass
class Model:
    """Strength ``(features - mean) / scale @ weights``; ``cut`` gets the score ``at_cut``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float
    at_cut: float = 0.3

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _widen((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.cut) / self.spread + np.log(self.at_cut / (1 - self.at_cut))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _widen(z: np.ndarray) -> np.ndarray:
    """Standardized features, cut at ten deviations, and their squares."""
    z = np.clip(z, -10, 10)
    return np.concatenate([z, z * z], axis=1)


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = 400_000, ridge: float = 1e-6, steps: int = 4000,
        seed: int = 7) -> Model:
    """Bradley-Terry weights from ``pairs`` random preferences of good over bad rows."""
    both = np.concatenate([good, bad]) if len(good) + len(bad) else np.zeros((1, good.shape[1]))
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale == 0] = 1.0
    high, low = _widen((good - mean) / scale), _widen((bad - mean) / scale)
    rng = np.random.default_rng(seed)
    weights = np.zeros(high.shape[1])
    if len(good) and len(bad):
        left, right = rng.integers(len(high), size=pairs), rng.integers(len(low), size=pairs)
        first, second, batch = np.zeros_like(weights), np.zeros_like(weights), 4096
        for step in range(1, steps + 1):  # Adam on mini-batches of pairs
            some = rng.integers(pairs, size=batch)
            gap = high[left[some]] - low[right[some]]
            pull = 1 / (1 + np.exp(np.clip(gap @ weights, -50, 50)))
            slope = -(gap * pull[:, None]).mean(axis=0) + ridge * weights
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope * slope
            rate = 0.05 * (1 - step / (steps + 1))
            weights -= rate * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    up, down = high @ weights, low @ weights
    cut = quantile_cut(up, down)
    spread = max(float(np.median(up) - np.median(down)) / 8, 1e-6) if len(up) and len(down) else 1.0
    return Model(mean, scale, weights, cut, spread)


def quantile_cut(up: np.ndarray, down: np.ndarray) -> float:
    """The quantile of all strengths that separates the labels best; the middle of it where several do.

    Best is the largest sum of both labels' shares on their own side.
    """
    if not len(up) or not len(down):
        return -1.0
    strengths = np.concatenate([up, down])
    order = np.argsort(strengths, kind="stable")
    label = np.concatenate([np.ones(len(up)), np.zeros(len(down))])[order]
    below = np.cumsum(1 - label) / len(down) + 1 - np.cumsum(label) / len(up)
    at = int(np.argmax(below))
    strengths = strengths[order]
    return float((strengths[at] + strengths[min(at + 1, len(strengths) - 1)]) / 2)


def _features_of(key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_blocks(whole, 1):
                x = features(*packed(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(
                        pa.list_(pa.float64()))], [key, "features"])
    return run


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 20_000, key: str = "doc_id", text: str = "text",
          label: str = "quality") -> Model:
    """Fit a model to the rows of ``labels`` whose key is in ``docs``; pass learners only.

    About ``per_label`` rows of each label learn, by a hash of the key. Labels other than
    0 and 1 and null keys or labels are ignored; of several labels of a key the largest
    counts. Rows that repeat a key are one learner, that with the smallest features, so no
    more rows than keys reach the driver. Without learners of both labels nothing tells
    good from bad: every document gets the one score, and none is rejected.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(
        F.max(label).cast("int").alias("_label"))
    many = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("_label") == 1, per_label / max(many.get(1, 0), 1)).otherwise(per_label / max(many.get(0, 0), 1))
    chosen = known.filter(F.pmod(F.xxhash64("_key", F.lit("quality")), F.lit(1 << 30)) < share * (1 << 30))
    learners = docs.select(F.col(key).alias("_key"), utf8(text).alias("_text")).join(
        F.broadcast(chosen), "_key")  # about per_label keys of each label
    kind = docs.schema[key].dataType
    read = learners.select("_key", "_text").mapInArrow(
        _features_of("_key"), T.StructType([T.StructField("_key", kind), T.StructField("features", T.ArrayType(T.DoubleType()))]))
    rows = read.groupBy("_key").agg(F.min("features").alias("features")).join(F.broadcast(chosen), "_key").select(
        "_label", "features").toArrow()
    y = rows.column("_label").to_numpy()
    x = np.array(rows.column("features").to_pylist(), float).reshape(len(y), len(NAMES))
    order = np.lexsort([*x.T, y])  # the same model however the rows arrive
    x, y = x[order], y[order]
    return fit(x[y == 1], x[y == 0])


def _scores(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in byte_blocks(whole, whole.num_columns - 1):
                score = model.score(features(*packed(batch.column(batch.num_columns - 1))))
                columns = [*batch.columns[:-1], pa.array(score), pa.array(score >= model.at_cut).cast(pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "score", "predicted"])
    return run


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns plus ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the cut).

    Both replace columns of these names. Null, empty and blank texts have the features
    zero and get a score like any other text. Rows are scored one by one: repeated rows
    get equal scores, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name.lower() not in ("score", "predicted")]
    out = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], utf8(text).alias("_body_of_text")).mapInArrow(
        _scores(shared), out)
