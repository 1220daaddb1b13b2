"""Exact nearest neighbours by cosine similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

def centroids(table: DataFrame, label: str, vector: str, dimensions: int) -> DataFrame:
    """Mean vector per label, averaged before the shuffle."""
    means = [F.avg(F.get(F.col(vector), F.lit(i))).alias(f"_d{i}") for i in range(dimensions)]
    return (
        table.groupBy(label).agg(*means)
        .select(label, F.array(*[f"_d{i}" for i in range(dimensions)]).alias(vector))
    )


def _best(similarity: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar entries; equal similarity goes to the smaller id."""
    if len(ids) > k:
        worst = np.partition(similarity, len(ids) - k)[len(ids) - k]
        kept = np.flatnonzero(similarity >= worst)
        similarity, ids = similarity[kept], ids[kept]
    order = np.lexsort((ids, -similarity))[:k]
    return similarity[order], ids[order]


def _names(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Row ids as an array that sorts: numbers as they are, anything else as text."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return np.array([str(v) for v in column.to_pylist()], dtype=str)


def _block_knn(table: DataFrame, block: DataFrame, k: int, row_id: str, query_id: str, vector: str,
               dimensions: int) -> DataFrame:
    rows = block.toArrow()
    flat = rows.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype("float64").reshape(rows.num_rows, dimensions)
    norms = np.linalg.norm(matrix, axis=1)
    names = rows.column("_query").filter(pa.array(norms > 0)).combine_chunks()
    shared = table.sparkSession.sparkContext.broadcast((matrix[norms > 0] / norms[norms > 0][:, None], names))
    usable = table.filter(
        F.col(row_id).isNotNull() & (F.size(vector) == dimensions) & ~F.exists(vector, lambda x: x.isNull())
    ).select(F.col(row_id).alias("_row"), vector)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_names = shared.value
        found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(queries)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids = _names(batch.column(0))
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dimensions)
            lengths = np.linalg.norm(vectors, axis=1)
            real = lengths > 0
            ids, vectors = ids[real], vectors[real] / lengths[real][:, None]
            for i, similarity in enumerate(queries @ vectors.T):
                if found[i] is not None:
                    similarity = np.concatenate([found[i][0], similarity])
                found[i] = _best(similarity, ids if found[i] is None else np.concatenate([found[i][1], ids]), k)
        if kind is None or not len(queries):
            return
        sizes = [len(f[1]) for f in found]
        yield pa.RecordBatch.from_arrays(
            [query_names.take(pa.array(np.repeat(np.arange(len(queries)), sizes))),
             pa.array(np.concatenate([f[1] for f in found]).tolist()).cast(kind),
             pa.array(np.concatenate([f[0] for f in found]))], names=["_query", "_row", "similarity"])

    out = StructType([block.schema["_query"], usable.schema["_row"], StructField("similarity", DoubleType())])
    local = usable.mapInArrow(search, out)
    order = Window.partitionBy("_query").orderBy(F.col("similarity").desc(), "_row")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("_query").alias(query_id), F.col("_row").alias(row_id), "rank", "similarity")
    )


def knn(
    table: DataFrame, queries: DataFrame, k: int, row_id: str = "vec_id",
    query_id: str = "query_id", vector: str = "embedding", block: int = 4096,
) -> DataFrame:
    """``k`` nearest rows for every query: ``query_id``, ``row_id``, ``rank``, ``similarity``.

    The table stays where it is: each task compares its rows with a block of queries and
    sends on ``k`` candidates per query. Queries are cut into blocks of about ``block`` by a
    hash of their id; each block is a broadcast of that many vectors and a pass over the
    table, so ``block`` times the vector size is what the driver holds.

    Vectors have to be of one length, that of the longest query. Queries and rows of
    another length, without an id, null, all zero or with null components take no part.
    Without queries there are no rows. Ids keep their type; equal similarity goes to the
    smaller id, and ids that are no integers compare as text.
    """
    found = queries.filter(F.col(query_id).isNotNull() & F.col(vector).isNotNull()
                           & ~F.exists(vector, lambda x: x.isNull()))
    size = found.agg(F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("d")).first()["d"]
    chosen = found.filter(F.size(vector) == size).select(F.col(query_id).alias("_query"), vector)
    blocks = max(1, math.ceil(chosen.count() / block))
    in_block = F.pmod(F.xxhash64("_query"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [
        _block_knn(table, chosen.filter(in_block == b), k, row_id, query_id, vector, size) for b in range(blocks)
    ])
