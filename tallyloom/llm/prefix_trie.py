"""Trie of conversation prefixes by vertical bitmaps.

Conversations are dealt to shards by a hash of their id, and to blocks of positions, so that
neither a common opening nor a long conversation makes a large group. Inside a group a bitmap
of conversations stands for every (position, turn). A node is the bitset of the conversations
that share a prefix; its children are its intersections with the bitmaps of the next position.

Shards hold parts of the same nodes. These meet under a 128-bit key of the prefix: sizes,
smallest members and endings add up there. Every node belongs to its smallest member, so what
is summed over subtrees counts once. A second pass over the groups adds up subtrees from below;
what later blocks hold is carried to a block by running sums per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import durable

#: Positions in a block, as a power of two, and conversations in a shard.
SHIFT, SHARD = 6, 512
BLOCK = 1 << SHIFT
WORDS = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "k1", "k2"]
_GROUP = ["_shard", "_block"]
_TURNLESS = "conv_id long"


def numbered(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, _slice, pos, total, t1, t2, words): every turn with its place in its conversation.

    Turns go by ``turn``, an integer, null first; equal ones by a hash of what they say. A
    conversation is cut into slices of 64 turn numbers, and the small table of slices tells
    how many turns lie before each. Null roles and texts are empty; rows without a
    conversation are none of any.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = table.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("_turn"),
        F.coalesce(F.shiftright(F.col(turn).cast("long"), SHIFT), F.lit(-(1 << 62))).alias("_slice"),
        F.xxhash64(F.lit(1), *said).alias("t1"), F.xxhash64(F.lit(2), *said).alias("t2"),
        F.regexp_count(said[1], F.lit(WORDS)).cast("long").alias("words"))
    keys = ["conv_id", "_slice"]
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(keys).agg(F.count("*").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    inside = Window.partitionBy(keys).orderBy(F.col("_turn").asc_nulls_first(), "t1", "t2")
    return (
        rows.withColumn("_at", F.row_number().over(inside) - 1).join(slices, keys)
        .select(*keys, (F.col("_at") + F.col("_before")).alias("pos"), "total", "t1", "t2", "words")
    )


def splice(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Give conversations the opening of another: (turns with a ``length``, conversations without turns).

    Conversation c takes the first h turns of conversation c - c % every, fewer if that has
    fewer, in place of its own first h; h is the crc32 of c as text modulo ``most``.
    """
    whose = F.col("conv_id")
    h = (F.crc32(whose.cast("string").cast("binary")) % most).cast("int")
    heads = (
        turns.filter((whose % every == 0) & (F.col("pos") < most - 1))
        .groupBy(whose.alias("_base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("_head"))
    )
    convs = (
        turns.filter("pos = 0").select("conv_id", "total", h.alias("_h"), (whose - whose % every).alias("_base"))
        .join(heads, "_base", "left")
        .withColumn("_m", F.least("_h", F.coalesce(F.size("_head"), F.lit(0))))
        .select("conv_id", "_h", "_m", "_head", (F.col("_m") + F.greatest(F.col("total") - F.col("_h"), F.lit(0))).alias("length"))
    )
    convs = durable(convs, "trie_conversations")
    # one row per slice meets the conversation, so a long conversation is not one join key
    moves = turns.select("conv_id", "_slice").distinct().join(convs.drop("_head"), "conv_id")
    own = turns.join(moves, ["conv_id", "_slice"]).filter("pos >= _h").select(
        "conv_id", (F.col("pos") - F.col("_h") + F.col("_m")).alias("pos"), "t1", "t2", "words", "length")
    taken = convs.filter("_m > 0").select(
        "conv_id", "length", F.explode(F.slice("_head", F.lit(1), F.col("_m"))).alias("_turn")
    ).select("conv_id", "_turn.pos", "_turn.t1", "_turn.t2", "_turn.words", "length")
    return own.unionByName(taken), convs.filter("length = 0").select("conv_id")


_LOCAL = ("_shard int, _block long, depth long, k1 long, k2 long, p1 long, p2 long, n long, least long, "
          "words long, ends array<long>")


def _bit(bits: int) -> int:
    """Place of the lowest bit."""
    return (bits & -bits).bit_length() - 1


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _grow(group: pa.Table) -> pa.Table:
    """The nodes of one shard and block: depth-first intersections of bitmaps."""
    shard, block = group.column("_shard")[0].as_py(), group.column("_block")[0].as_py()
    conv, pos, k1, k2, words, length, entry = (group.column(c).to_numpy(zero_copy_only=False) for c in
                                               ("conv_id", "pos", "k1", "k2", "words", "length", "_entry"))
    ids, who = np.unique(conv, return_inverse=True)
    names = ids.tolist()
    start = block << SHIFT
    bitmaps: list[dict[tuple[int, int], int]] = [{} for _ in range(BLOCK)]
    spoken: list[dict[int, tuple[int, int]]] = [{} for _ in range(BLOCK)]
    count: dict[tuple[int, int], int] = {}
    ending = [0] * BLOCK
    entries = {c: (0, 0) for c in range(len(names))}
    for c, p, a, b, w, size, is_entry in zip(who.tolist(), (pos - start).tolist(), k1.tolist(), k2.tolist(),
                                             words.tolist(), length.tolist(), entry.tolist(), strict=True):
        if is_entry:
            entries[c] = (a, b)
            continue
        turn = (a, b)
        bitmaps[p][turn] = bitmaps[p].get(turn, 0) | 1 << c
        spoken[p][c] = turn
        count[turn] = w
        if p + start + 1 == size:
            ending[p] |= 1 << c
    out: list[tuple] = []
    stack: list[tuple[int, int, tuple[int, int]]] = []
    roots: dict[tuple[int, int], int] = {}
    for c, key in entries.items():
        roots[key] = roots.get(key, 0) | 1 << c
    for key, bits in roots.items():
        if block:
            out.append((start, *key, 0, 0, 0, None, 0, []))
        stack.append((0, bits, key))
    while stack:
        at, bits, key = stack.pop()
        left = bits
        while left:
            turn = spoken[at][_bit(left)]
            child = bits & bitmaps[at][turn]
            left &= ~child
            own = (key[0] ^ turn[0], key[1] ^ turn[1])
            done = child & ending[at]
            out.append((start + at + 1, *own, *key, child.bit_count(), names[_bit(child)], count[turn],
                        [names[c] for c in _members(done)]))
            if at + 1 < BLOCK and child != done:
                stack.append((at + 1, child & ~done, own))
    columns = list(zip(*out, strict=True)) if out else [()] * 9
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())]
    return pa.table([pa.array([shard] * len(out), pa.int32()), pa.array([block] * len(out), pa.int64()),
                     *[pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]],
                    names=["_shard", "_block", *KEY, "p1", "p2", "n", "least", "words", "ends"])


_SUMS = "depth long, k1 long, k2 long, conv_id long, parent_conv_id long, n_convs long, children long, leaves long, saved long"


def _add_up(group: pa.Table) -> pa.Table:
    """Sums over the subtrees of one shard and block, children before parents."""
    rows = group.to_pydict()
    n = group.num_rows
    at = {}
    for i in range(n):
        if not rows["carried"][i]:
            at[rows["depth"][i], rows["k1"][i], rows["k2"][i]] = i
    children, leaves, saved, parent_conv = [0] * n, [0] * n, [0] * n, [None] * n
    mine = [rows["least"][i] is not None and rows["least"][i] == rows["conv_id"][i] for i in range(n)]
    for i in range(n):
        if rows["carried"][i]:
            exit_ = at[rows["depth"][i], rows["k1"][i], rows["k2"][i]]
            leaves[exit_] += rows["leaf"][i]
            saved[exit_] += rows["saved"][i]
        elif mine[i]:
            leaves[i] += rows["leaf"][i]
            saved[i] += rows["saved"][i]
    for i in sorted(at.values(), key=lambda i: -rows["depth"][i]):
        above = at.get((rows["depth"][i] - 1, rows["p1"][i], rows["p2"][i]))
        if above is None or rows["least"][i] is None:
            continue
        if rows["least"][above] is not None:
            leaves[above] += leaves[i]
            saved[above] += saved[i]
        if mine[i]:
            children[above] += 1
            parent_conv[i] = rows["conv_id"][above]
    kept = sorted(at.values())
    # the top of a later block belongs to the block before, which counts what lies below it
    top = [rows["least"][i] is None for i in kept]
    take = lambda values: pa.array([values[i] for i in kept], pa.int64())
    below = lambda values: pa.array([0 if t else values[i] for i, t in zip(kept, top, strict=True)], pa.int64())
    own = pa.array([rows["conv_id"][i] if mine[i] else None for i in kept], pa.int64())
    return pa.table([take(rows["depth"]), take(rows["k1"]), take(rows["k2"]), own, take(parent_conv),
                     take(rows["n_convs"]), take(children), below(leaves), below(saved)],
                    names=[*KEY, "conv_id", "parent_conv_id", "n_convs", "children", "leaves", "saved"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, id) rows as runs of ids per node, as text; a run ends with its batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        ids = batch.column(3).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        last = np.r_[first[1:], len(ids)]
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(first, last, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(k[first]) for k in keys], pa.array(ids[first]), pa.array(texts, pa.string())],
            [*KEY, "_first", "_ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the runs of each node on end; rows come sorted by node and first id."""
    now, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*[pa.array([v], pa.int64()) for v in now], pa.array([state.hexdigest()])], [*KEY, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
            if key != now:
                if now is not None:
                    yield done()
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if now is not None:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id); the ids of one node may be on many tasks."""
    order = [*KEY, "conv_id"]
    runs = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _runs, "depth long, k1 long, k2 long, _first long, _ids string")
    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "_first").mapInArrow(
        _digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _block(depth_or_pos: Column) -> Column:
    return F.shiftright(depth_or_pos, SHIFT)


def trie(turns: DataFrame, turnless: DataFrame | None = None, per_shard: int = SHARD) -> DataFrame:
    """One row per distinct prefix of the conversations.

    ``turns`` holds conv_id, pos (from 0, without gaps), t1, t2 (128 bits of hash of a turn),
    words and length (turns of the conversation); ``turnless`` conversations that have none.
    Returns conv_id (the smallest that starts so), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens (per node of the subtree the words of its last
    turn times all its conversations but one) and ends_sha256 (of the ids of those that end
    here, in order). Repeated conversations are members of the same nodes. Without
    conversations there is no node, not even a root.
    """
    spark = turns.sparkSession
    turnless = turnless if turnless is not None else spark.createDataFrame([], _TURNLESS)
    turns = durable(turns.select(
        "conv_id", "pos", F.xxhash64("t1", "t2", "pos").alias("k1"), F.xxhash64("t2", "pos", "t1").alias("k2"),
        "words", "length"), "trie_turns")
    has = turns.filter("pos = 0").select("conv_id").unionByName(turnless)
    total, least = has.agg(F.count("*"), F.min("conv_id")).first()
    if not total:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, "
                                         "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    shard = F.pmod(F.xxhash64("conv_id"), F.lit(-(-total // per_shard))).cast("int")
    # what a long conversation said before each of its blocks
    earlier = "OVER (PARTITION BY conv_id ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    entries = (
        turns.filter(F.col("length") > BLOCK).groupBy("conv_id", _block(F.col("pos")).alias("_block"))
        .agg(F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"))
        .select("conv_id", "_block", F.expr(f"bit_xor(x1) {earlier}").alias("k1"), F.expr(f"bit_xor(x2) {earlier}").alias("k2"))
        .filter("_block > 0")
    )
    entries = durable(entries, "trie_entries")
    rows = turns.withColumn("_entry", F.lit(False)).unionByName(entries.select(
        "conv_id", F.shiftleft("_block", SHIFT).alias("pos"), "k1", "k2", F.lit(0).cast("long").alias("words"),
        F.lit(0).cast("long").alias("length"), F.lit(True).alias("_entry")))
    local = rows.withColumns({"_shard": shard, "_block": _block(F.col("pos"))}).groupBy(_GROUP).applyInArrow(_grow, _LOCAL)
    local = durable(local, "trie_local")
    nodes = local.groupBy(KEY).agg(
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.max("words").alias("words"),
        F.sum(F.size("ends")).alias("_ends"))
    nodes = durable(nodes.select(
        *KEY, "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        (F.col("_ends") == F.col("n_convs")).cast("long").alias("leaf")), "trie_nodes")
    spoken, leaves, saved, first = nodes.agg(
        F.count("*"), F.sum("leaf"), F.sum("saved"), F.count_if(F.col("depth") == 1)).first()

    # what a conversation owns in its block and all later ones, at the node where the block before ends
    owned = nodes.groupBy("conv_id", _block(F.col("depth") - 1).alias("_block")).agg(
        F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    on = Window.partitionBy("conv_id").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, 0)
    from_here = lambda c: F.coalesce(F.sum(c).over(on), F.lit(0)).alias(c)
    carried = entries.join(owned.filter("_block > 0"), ["conv_id", "_block"], "left").select(
        shard.alias("_shard"), (F.col("_block") - 1).alias("_block"), F.shiftleft("_block", SHIFT).alias("depth"),
        "k1", "k2", F.lit(True).alias("carried"), from_here("leaf"), from_here("saved"))
    parts = local.select("_shard", "_block", *KEY, "p1", "p2", "least", F.lit(False).alias("carried")).join(nodes, KEY)
    sums = parts.unionByName(carried, allowMissingColumns=True).groupBy(_GROUP).applyInArrow(_add_up, _SUMS)
    whole = sums.groupBy(KEY).agg(
        F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"), F.sum("children").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    whole = whole.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_conv_id")))
    root = spark.range(1).select(
        *[F.lit(v).cast("long").alias(c) for c, v in (
            ("depth", 0), ("k1", 0), ("k2", 0), ("conv_id", least), ("parent_conv_id", None), ("n_convs", total),
            ("n_children", first), ("n_leaves", leaves if spoken else 1), ("saved_tokens", saved or 0))])
    ends = local.select(*KEY, F.explode("ends").alias("conv_id")).unionByName(
        turnless.select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id"))
    return whole.unionByName(root).join(end_digests(ends), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(table: DataFrame, every: int = 20, most: int = 4, per_shard: int = SHARD) -> DataFrame:
    """The trie of a table of conversations after :func:`splice`; see :func:`trie` for the columns."""
    turns = durable(numbered(table), "trie_numbered")
    return trie(*splice(turns, every, most), per_shard)
