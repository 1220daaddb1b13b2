"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. A key's hash names its cell, virtual nodes sit on
cells, and a cell's home is the first virtual node clockwise. Every shard first takes
rows of its own cells, in ring order, up to its capacity; what overflows continues
clockwise to the next virtual nodes until a shard has room. Only the counts per cell,
a table whose size is a parameter and not that of the data, reach the driver, which
turns them into ranges of ranks per cell. Rows find their place by rank within the cell.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from hashlib import blake2b

from pyspark.sql import DataFrame, Window, functions as F

from .common import durable

#: (cell, first rank, end rank, shard, slot of rank 0 of this range minus the first rank)
Run = tuple[int, int, int, int, int]


def virtual_nodes(shards: int, each: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; one that meets a taken cell goes to the next free one."""
    if shards * each > cells:
        raise ValueError(f"{shards} shards of {each} virtual nodes need more than {cells} cells")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for copy in range(each):
            cell = int.from_bytes(blake2b(f"shard {shard} node {copy}".encode(), digest_size=8).digest()) % cells
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard. Without slack they sum up to the rows, at most one apart."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[Run]:
    """Ranges of ranks of each cell and their shard, given the rows per cell and the capacities."""
    places = [cell for cell, _ in nodes]
    left, filled = list(room), [0] * len(room)
    runs: list[Run] = []
    waiting: dict[int, list[list[int]]] = {}

    def put(cell: int, first: int, n: int, shard: int) -> None:
        runs.append((cell, first, first + n, shard, filled[shard] - first))
        left[shard] -= n
        filled[shard] += n

    for cell in sorted(counts):
        home = bisect_left(places, cell) % len(nodes)
        shard = nodes[home][1]
        stays = min(counts[cell], left[shard])
        if stays:
            put(cell, 0, stays, shard)
        if stays < counts[cell]:
            waiting.setdefault(home, []).append([cell, stays, counts[cell] - stays])
    carried: deque[list[int]] = deque()
    for step in range(2 * len(nodes)):  # the second lap visits every shard that still has room
        at = step % len(nodes)
        carried.extend(waiting.pop(at, ()))
        shard = nodes[at][1]
        while carried and left[shard]:
            bunch = carried[0]
            n = min(bunch[2], left[shard])
            put(bunch[0], bunch[1], n, shard)
            bunch[1] += n
            bunch[2] -= n
            if not bunch[2]:
                carried.popleft()
    if carried or waiting:
        raise ValueError("the capacities of all shards together are below the number of rows")
    return runs


def shard(docs: DataFrame, shards: int = 40, nodes: int = 64, cells: int = 1 << 14, slack: float = 0.0,
          key: str = "doc_id", text: str = "text", subcells: int = 16) -> DataFrame:
    """A shard and a gapless slot for every row.

    Returns the key, ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``shard``
    and ``slot``. With ``slack`` 0 shard counts are at most one apart; with more, no shard
    exceeds (1 + slack) times the mean and fewer rows leave their home.

    A null or empty text has size 16 and checksum 0. Rows with a null key hash like the
    empty key. Rows that agree in key, size and checksum are counted as one before any
    sort and spread again at the end; the rows of one key are sorted in ``subcells``
    pieces. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"))
    ring = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = (
        rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
        .withColumn("cell", F.pmod(ring, F.lit(cells)).cast("int"))
        .withColumn("sub", F.pmod(F.xxhash64("size", "text_crc32", "doc_id"), F.lit(subcells)).cast("int"))
    )
    rows = durable(rows, "shard_rows")
    counts = rows.groupBy("cell", "sub").agg(F.sum("n").alias("n"))
    by_cell = {r["cell"]: r["n"] for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    runs = walk(by_cell, virtual_nodes(shards, nodes, cells), capacities(sum(by_cell.values()), shards, slack))
    plan = spark.createDataFrame(runs or [(-1, 0, 0, 0, 0)],
                                 "cell int, lo long, hi long, shard int, shift long")
    before = counts.select(
        "cell", "sub",
        (F.sum("n").over(Window.partitionBy("cell").orderBy("sub")) - F.col("n")).alias("before"))
    within = Window.partitionBy("cell", "sub").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("within", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ranked = ranked.join(before, ["cell", "sub"]).withColumn("first", F.col("before") + F.col("within"))
    # the plan has at most two rows per cell and virtual node, whatever the data
    placed = ranked.join(F.broadcast(plan), "cell").filter(
        (F.col("first") < F.col("hi")) & (F.col("first") + F.col("n") > F.col("lo")))
    rank = F.explode(F.sequence(F.greatest("first", "lo"), F.least(F.col("first") + F.col("n"), F.col("hi")) - 1))
    return (
        placed.select("doc_id", "size", "text_crc32", "shard", "shift", rank.alias("rank"))
        .select(F.col("doc_id").alias(key), "size", "text_crc32", "shard", (F.col("rank") + F.col("shift")).alias("slot"))
    )
