"""Exact top-k search by distributed histogram selection.

Every pass scores all vectors against a block of queries. Tasks count the scores of each
query in the bins of its current interval, the global histogram tells the bin that holds
the kth score, and that bin is the next interval, until it is one value wide. A last pass
fetches what lies above the kth value, and of the rows at it the smallest ids.

A task reports only bins down to its own kth score. A lower bin cannot hold the global
kth score, so at most k bins of a query leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import durable
from .vectors import matrix, vectors

#: Doubles hold all whole numbers up to here, and beyond it only whole numbers. A score is a long.
EXACT, LARGEST = 1 << 53, (1 << 63) - 1


def quantized(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(_id, _dim, _vec) with components floor(256 x), as doubles that hold them exactly."""
    def whole(x):
        return F.when(F.abs(x * 256) < EXACT, F.floor(x * 256).cast("double")).otherwise(x * 256)

    return vectors(table, key, vector, zero=True).withColumn("_vec", F.transform("_vec", whole))


_whole = np.frompyfunc(int, 1, 1)


def products(asked: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers as longs; an error if one is none.

    Where no sum can pass 2**53 doubles are exact; the few larger rows are multiplied as
    Python integers, with those queries that are too large for doubles too.
    """
    reach, top = np.abs(asked).sum(axis=1), np.abs(x).max(axis=1, initial=0.0)
    if reach.max(initial=0.0) * top.max(initial=0.0) < EXACT:
        return (asked @ x.T).astype(np.int64)
    score = np.zeros((len(asked), len(x)), np.int64)
    large = reach.max() * top >= EXACT
    score[:, ~large] = (asked @ x[~large].T).astype(np.int64)
    wide = reach * top.max() >= EXACT
    score[np.ix_(~wide, large)] = (asked[~wide] @ x[large].T).astype(np.int64)
    exact = _whole(asked[wide]) @ _whole(x[large]).T
    if exact.size and max(exact.max(), -exact.min()) > LARGEST:
        raise OverflowError("an inner product does not fit a long")
    score[np.ix_(wide, large)] = exact.astype(np.int64)
    return score


def _above(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """high - low without a sign, as it may pass a long."""
    return high.astype(np.uint64) - low.astype(np.uint64)


class _Block:
    """Queries of one length with their intervals [low, high), the bins of these, and the scores still wanted."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, bins: int):
        self.ids, self.rows, self.low, self.high, self.wanted, self.bins = ids, rows, low, high, wanted, bins
        self.width = (_above(low, high) - np.uint64(1)) // np.uint64(bins) + np.uint64(1)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some rows, their exact integer scores per query); the query's own rows are lowest."""
        step = max(1, (1 << 21) // max(len(self.ids), 1))
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            ids = some.column(0).to_numpy(zero_copy_only=False)
            score = products(self.rows, matrix(some.column(1), self.rows.shape[1]))
            score[self.ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
            yield ids, score

    def bins_of(self, score: np.ndarray) -> np.ndarray:
        """How many scores of each query are in each bin of its interval, bins on end."""
        inside = (score >= self.low[:, None]) & (score < self.high[:, None])
        at = (_above(self.low[:, None], score) // self.width[:, None]).astype(np.int64)
        query, _ = np.nonzero(inside)
        return np.bincount(query * self.bins + at[inside], minlength=len(self.ids) * self.bins)

    def narrowed(self, query: np.ndarray, at: np.ndarray, total: np.ndarray, own: np.ndarray, lowest: int) -> _Block:
        """The same queries, each with the bin that holds its kth score for an interval.

        Of the given bins ``total`` scores lie in the bin or above, ``own`` in it.
        """
        n = len(self.ids)
        hit = (total >= self.wanted[query]) & (total - own < self.wanted[query])
        query, at, before = query[hit], at[hit], (total - own)[hit]
        # a query with too few candidates takes them all: its kth value is below every score
        low, high, left = np.full(n, lowest - 1), np.full(n, lowest), np.zeros(n, np.int64)
        from_low = at.astype(np.uint64) * self.width[query]
        whole = _above(self.low[query], self.high[query])
        low[query] = (self.low[query].astype(np.uint64) + from_low).astype(np.int64)
        up_to = from_low + np.minimum(self.width[query], whole - from_low)
        high[query] = (self.low[query].astype(np.uint64) + up_to).astype(np.int64)
        left[query] = self.wanted[query] - before
        return _Block(self.ids, self.rows, low, high, left, self.bins)

    def open(self) -> bool:
        return bool((_above(self.low, self.high) > 1).any())


def _count(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[_Block] = shared.value
        counts = [np.zeros(len(b.ids) * b.bins, np.int32) for b in blocks]  # a task has fewer rows than that
        for batch in batches:
            for block, own in zip(blocks, counts, strict=True):
                for _, score in block.scores(batch):
                    own += block.bins_of(score).astype(np.int32)
        for number, (block, own) in enumerate(zip(blocks, counts, strict=True)):
            own = own.reshape(len(block.ids), block.bins)
            above = own[:, ::-1].cumsum(axis=1, dtype=np.int64)[:, ::-1] - own
            query, at = np.nonzero((own > 0) & (above < block.wanted[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(query), number, np.int32)), pa.array(query.astype(np.int32)), pa.array(at.astype(np.int32)),
                 pa.array(own[query, at].astype(np.int64))], ["_block", "_query", "_bin", "_n"])
    return run


def _fetch(shared) -> Callable:
    """Rows above the kth value, and the smallest ids at it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[_Block] = shared.value
        ties = [[np.zeros(0, np.int64)] * len(b.ids) for b in blocks]
        for batch in batches:
            for block, own in zip(blocks, ties, strict=True):
                for ids, score in block.scores(batch):
                    query, row = np.nonzero(score > block.low[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.ids[query]), pa.array(ids[row]), pa.array(score[query, row])],
                        ["query_id", "vec_id", "score"])
                    equal = score == block.low[:, None]
                    for query in np.flatnonzero(equal.any(axis=1)):
                        own[query] = np.sort(np.concatenate([own[query], ids[equal[query]]]))[:block.wanted[query]]
        for block, own in zip(blocks, ties, strict=True):
            sizes = [len(t) for t in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(block.ids, sizes)), pa.array(np.concatenate([np.zeros(0, np.int64), *own])),
                 pa.array(np.repeat(block.low, sizes))], ["query_id", "vec_id", "score"])
    return run


def _answer(blocks: list[_Block], data: DataFrame) -> DataFrame:
    """All passes for some blocks of queries of one length; each pass reads the table once for all of them."""
    spark = data.sparkSession
    lowest = min(int(b.low.min()) for b in blocks)
    while any(b.open() for b in blocks):
        counts = data.mapInArrow(_count(spark.sparkContext.broadcast(blocks)), "_block int, _query int, _bin int, _n long")
        down = Window.partitionBy("_block", "_query").orderBy(F.desc("_bin"))
        located = (
            counts.groupBy("_block", "_query", "_bin").agg(F.sum("_n").alias("_n"))
            .withColumn("_up_to", F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
            .filter(F.col("_up_to") - F.col("_n") < max(int(b.wanted.max()) for b in blocks))
        )
        rows = located.toArrow()  # at most k bins of each query of the blocks
        number, *found = (rows.column(c).to_numpy() for c in ("_block", "_query", "_bin", "_up_to", "_n"))
        blocks = [b.narrowed(*(c[number == i] for c in found), lowest) for i, b in enumerate(blocks)]
    return data.mapInArrow(_fetch(spark.sparkContext.broadcast(blocks)), "query_id long, vec_id long, score long")


def search(queries: DataFrame, table: DataFrame, k: int = 5, bins: int = 1024, block: int = 4096, together: int = 8,
           key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query over all other rows, exactly.

    Components count as floor(256 x). Returns query_id, rank (from 1), vec_id, score; ties
    go to the smaller id; fewer than ``k`` candidates are all returned. Rows with the id of
    the query are its own. Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows without an id; an inner product beyond a long is an
    error. Vectors are scored against those of their own length. Rows that repeat an id are
    answered once for each id, and stand in answers as often as they occur. An empty table
    gives no rows. Queries are taken in blocks of about ``block``, and ``together`` blocks at a
    time: these are one broadcast and a few scans of the table, and a task holds four bytes
    for each of their bins.
    """
    spark = table.sparkSession
    rows, asked = quantized(table, key, vector), quantized(queries, key, vector).dropDuplicates(["_id", "_dim"])
    norm = F.sqrt(F.aggregate("_vec", F.lit(0.0), lambda total, x: total + x * x))
    many = asked.groupBy("_dim").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()
    longest = {r["_dim"]: r["norm"] for r in rows.groupBy("_dim").agg(F.max(norm).alias("norm")).collect()}
    answers = []
    for group in many:
        dim, parts = group["_dim"], -(-group["n"] // block)
        if dim not in longest:
            continue
        bound = min(int(group["norm"] * longest[dim] * (1 + 1e-9)) + 1, LARGEST - 1)
        data = rows.filter(F.col("_dim") == dim).select("_id", "_vec")
        own = asked.filter(F.col("_dim") == dim).withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(parts)))
        for first in range(0, parts, together):
            taken = own.filter(F.col("_part").between(first, first + together - 1)).orderBy("_part", "_id").toArrow()
            part = taken.column("_part").to_numpy()
            blocks = []
            for number in np.unique(part):
                some = taken.filter(pa.array(part == number))
                ids = some.column("_id").to_numpy()
                n = len(ids)
                blocks.append(_Block(ids, matrix(some.column("_vec").combine_chunks(), dim), np.full(n, -bound),
                                     np.full(n, bound + 1), np.full(n, k), bins))
            if blocks:
                answers.append(durable(_answer(blocks, data), "topk_answers"))
    if not answers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        reduce(DataFrame.union, answers).withColumn("rank", rank).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
