"""Approximate nearest neighbours by cross-polytope hashing.

A table turns all vectors by a pseudo-rotation, three rounds of random signs and a fast
Hadamard transform, and puts each vector into the bucket of its nearest signed axis. A
query probes the buckets of its ``probes`` nearest signed axes in every table. Queries
and vectors of a bucket meet in blocks of bounded size; a block keeps the best of each
query by exact inner product, and the best over all blocks are the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import durable
from .vectors import matrix, vectors

_HASHED = "_id long, _dim int, _table int, _code int, _vec binary"


def rotations(dim: int, tables: int, seed: int) -> np.ndarray:
    """Signs of ``tables`` pseudo-rotations for vectors of a length, padded to a power of two."""
    return np.random.default_rng([seed, dim]).choice(
        np.array([-1.0, 1.0]), size=(tables, 3, 1 << max(dim - 1, 0).bit_length()))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x, padded with zeros, after one pseudo-rotation."""
    size = signs.shape[1]
    y = np.zeros((len(x), size))
    y[:, :x.shape[1]] = x
    for round_ in signs:
        y = y * round_
        half = 1
        while half < size:
            y = y.reshape(len(x), size // (2 * half), 2, half)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), size)
            half *= 2
    return y


def nearest_axes(y: np.ndarray, n: int) -> np.ndarray:
    """The n nearest signed axes of every row: 2i for axis i, 2i + 1 for its opposite; nearest first."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    n = min(n, both.shape[1])
    if n == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :n]


def _hash(tables: int, probes: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    x = matrix(batch.column(2).take(pa.array(rows)), int(dim))
                    length = np.abs(x).max(axis=1, keepdims=True)
                    unit = x / length
                    packed = [v.tobytes() for v in x]
                    for number, signs in enumerate(rotations(int(dim), tables, seed)):
                        codes = nearest_axes(rotate(unit, signs), probes)
                        n = codes.shape[1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(ids[rows], n)), pa.array(np.full(len(rows) * n, dim, np.int32)),
                             pa.array(np.full(len(rows) * n, number, np.int32)),
                             pa.array(codes.ravel().astype(np.int32)),
                             pa.array(packed, pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), n)))],
                            ["_id", "_dim", "_table", "_code", "_vec"])
    return run


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same for the same rows wherever they stand."""
    return (a * b).sum(axis=1)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best rows of each query, ties to the smaller id; own rows excluded.

    A fast product finds all rows within rounding of the kth best; these are scored again
    one by one. ``rows`` must be in order of ``ids``; of equal rows only the first k + 1 are used.
    """
    seen: dict[bytes, int] = {}
    keep = []
    for at, row in enumerate(rows):
        name = row.tobytes()
        seen[name] = seen.get(name, 0) + 1
        if seen[name] <= k + 1:
            keep.append(at)
    if len(keep) < len(rows):
        rows, ids = rows[keep], ids[keep]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 21) // max(len(rows), 1))
    largest = np.abs(rows).max(initial=0.0) * rows.shape[1]
    for at in range(0, len(queries), step):
        some, own = queries[at:at + step], query_ids[at:at + step]
        fast = some @ rows.T
        fast[own[:, None] == ids[None, :]] = -np.inf
        near = 1e-12 * largest * np.abs(some).max(axis=1)
        if len(rows) > k:
            least = np.partition(fast, len(rows) - k, axis=1)[:, len(rows) - k] - near
        else:
            least = np.full(len(some), -np.finfo(float).max)
        q, r = np.nonzero((fast >= least[:, None]) & (fast > -np.inf))
        score = np.concatenate([inner(some[q[i:i + 65536]], rows[r[i:i + 65536]])
                                for i in range(0, len(q), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.searchsorted(q, np.arange(len(some)))
        top = np.arange(len(q)) - first[q] < k
        out.append((own[q[top]], ids[r[top]], score[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 2 + (np.zeros(0),)


def _meet(k: int) -> Callable:
    """One block: its queries against its vectors."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = []
        for side in (left, right):
            ids = side.column("_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            dim = side.column("_dim")[0].as_py() if len(ids) else 1
            raw = b"".join(side.column("_vec").to_pylist())
            columns += [ids[order], np.frombuffer(raw, np.float64).reshape(-1, dim)[order]]
        if not len(columns[0]) or not len(columns[2]):
            q, v, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            q, v, score = best(columns[1], columns[0], columns[3], columns[2], k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(score)})
    return run


def search(queries: DataFrame, table: DataFrame, k: int = 20, tables: int = 8, probes: int = 16, seed: int = 1,
           block: int = 8192, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each query, by inner product in double precision.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. Candidates
    are all rows with another id. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows without an id; vectors are compared
    with those of their own length only. Rows that repeat an id count once if they are
    equal. A query that meets fewer than ``k`` rows in its buckets is compared with all
    rows, so that it gets ``k`` answers, or all there are. Buckets are cut into blocks of about ``block`` vectors and ``block`` queries,
    however many rows share one. An empty table gives no rows. Hashing looks at
    directions: for vectors of very different lengths recall is not what it is for unit
    vectors.
    """
    data, asked = vectors(table, key, vector), vectors(queries, key, vector)
    found = durable(_search(asked, data, k, tables, probes, seed, block), "ann_found")
    many = found.groupBy(F.col("query_id").alias("_id")).agg(F.count("*").alias("_n"))
    few = durable(asked.join(many, "_id", "left").filter(F.coalesce("_n", F.lit(0)) < k).select(asked.columns), "ann_few")
    if few.isEmpty():
        return found
    # one table whose every axis is probed holds all rows
    again = _search(few, data, k, 1, _EVERY, seed, block)
    return found.join(few.select(F.col("_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)


_EVERY = 1 << 30


def _search(queries: DataFrame, table: DataFrame, k: int, tables: int, probes: int, seed: int, block: int) -> DataFrame:
    """The best of the rows (_id, _dim, _vec) that share a bucket with a query."""
    data = table.mapInArrow(_hash(tables, 1, seed), _HASHED)
    asked = queries.mapInArrow(_hash(tables, probes, seed), _HASHED)
    bucket = ["_dim", "_table", "_code"]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(bucket).agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    # one row per bucket in use: at most tables * 2 * padded length for every length
    sizes = F.broadcast(blocks(data, "_blocks").join(blocks(asked, "_query_blocks"), bucket))
    salt = lambda n: F.pmod(F.xxhash64("_id", F.lit("block")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, bucket).select(
        *asked.columns, salt("_query_blocks").alias("_q"), each("_blocks").alias("_d"))
    right = data.join(sizes, bucket).select(
        *data.columns, salt("_blocks").alias("_d"), each("_query_blocks").alias("_q"))
    cell = [*bucket, "_q", "_d"]
    found = left.groupBy(cell).cogroup(right.groupBy(cell)).applyInArrow(
        _meet(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
