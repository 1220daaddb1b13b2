"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A signature has ``SYMBOLS`` b-bit minimum hashes of a document's shingles. It is split into
chunks. Two signatures with at most ``DISTANCE`` differing symbols have, by the pigeonhole
principle, a chunk with at most ``ERRORS`` of them; every chunk is entered in the index once
for each way of leaving out that many symbols, so such a pair is sure to meet in a bucket.
Documents at the similarity threshold exceed ``DISTANCE`` with a chance of about 3e-5.

Equal shingle sets are one class from the start. Only connected components are wanted, so
a bucket's classes are first compared with its smallest one, its pivot, alone; then, in
buckets whose classes are not yet connected, all pairs from different components are
compared, each pair in the first bucket that it shares. Candidates within the distance are
confirmed on their whole shingle sets. Pairs of small buckets become rows for that; in
large buckets, which copies of one text fill, the sets meet in blocks per pivot, and only
links leave a block. Nothing but counters reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import byte_blocks, durable, mix, packed, small_batches, unused, utf8, word_hashes

SYMBOLS, CHUNK, ERRORS = 80, 5, 1
#: One less than what would spoil every chunk.
DISTANCE = SYMBOLS // CHUNK * (ERRORS + 1) - 1
#: Classes up to which the pairs of a bucket become rows, and classes of a block in larger ones.
SMALL, BLOCK = 64, 1024
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_PLACES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a shorter text is one n-gram."""
    hashes, edges = word_hashes(raw, offsets)
    n = len(hashes)
    runs = np.zeros(max(n - words + 1, 0), np.uint64)
    for at in range(words if len(runs) else 0):
        runs += hashes[at:at + len(runs)] * _PLACES[at]
    runs = mix(runs)
    out = []
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if end - begin >= words:
            out.append(np.unique(runs[begin:end - words + 1]))
        elif end > begin:
            whole = (hashes[begin:end] * _PLACES[:end - begin]).sum(dtype=np.uint64)
            out.append(mix(np.array([whole + np.uint64(end - begin)], np.uint64) ^ _PLACES[words]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Low 16 bits of ``SYMBOLS`` minimum hashes of each set; sets must not be empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    all_of = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    for at in range(SYMBOLS if sets else 0):
        least = np.minimum.reduceat((all_of ^ _XOR[at]) * _TIMES[at], starts)
        out[:, at] = mix(least).astype(np.uint16)
    return out


def _sketch(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_blocks(whole, 1, 1 << 22):
                sets = shingles(*packed(batch.column(1)), words)
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                signed = signatures([sets[i] for i in some])
                names: list[bytes | None] = [None] * len(sets)
                signs: list[bytes | None] = [None] * len(sets)
                for row, i in enumerate(some.tolist()):
                    names[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    signs[i] = signed[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                     pa.array(signs, pa.binary())], ["_doc", "text_hash", "n_shingles", "_set", "_sign"])
    return run


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index keys of each class: every chunk with every symbol left out once."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            signs = _signs(batch.column(1)).astype(np.uint64)
            keys = []
            for slot in range(SYMBOLS):
                chunk, gap = divmod(slot, CHUNK)
                left = [chunk * CHUNK + i for i in range(CHUNK) if i != gap]
                joined = np.zeros(len(signs), np.uint64)
                for symbol in left:
                    joined = joined << np.uint64(16) | signs[:, symbol]
                keys.append(mix(joined * _PLACES[0] + np.uint64(slot)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.stack(keys, axis=1).ravel()),
                 batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), SYMBOLS))),
                 pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int32), batch.num_rows))], ["_key", "_node", "_slot"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are within the distance."""
    for batch in batches:
        far = (_signs(batch.column(2)) != _signs(batch.column(3))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["_a", "_b"]).filter(
            pa.array(far <= DISTANCE))


def first_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first index slot that both signatures of each row pair share; they must be within the distance."""
    wrong = (a != b).reshape(len(a), -1, CHUNK)
    chunk = (wrong.sum(axis=2) <= ERRORS).argmax(axis=1)
    return chunk * CHUNK + wrong[np.arange(len(a)), chunk].argmax(axis=1)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows that agree in ``names``, run by run, of input sorted by these."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        cells = np.stack([table.column(c).to_numpy() for c in names], axis=1)
        edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist()]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(begin, end - begin)
        held = table.slice(edges[-1])
    if held is not None:
        yield held.combine_chunks()


def _pairs_within(run: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row a, row b, signature a, signature b) within the distance, of different components, smaller node first."""
    signs = _signs(run.column("_sign"))
    nodes, parts = run.column("_node").to_numpy(), run.column("_part").to_numpy()
    step = max(1, (1 << 22) // (len(run) * SYMBOLS))
    for at in range(0, len(run), step):
        far = (signs[at:at + step, None, :] != signs[None, :, :]).sum(axis=2, dtype=np.uint8)
        good = (far <= DISTANCE) & (parts[at:at + step, None] != parts) & (nodes[at:at + step, None] < nodes)
        a, b = np.nonzero(good)
        if len(a):
            yield a + at, b, signs[a + at], signs[b]


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each small bucket; input is sorted by bucket."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for run in _runs(batches, ["_key"]):
        if len(run) > 1:
            slot, nodes = run.column("_slot")[0].as_py(), run.column("_node").to_numpy()
            for a, b, of_a, of_b in _pairs_within(run):
                mine = first_slot(of_a, of_b) == slot
                found.append((nodes[a[mine]], nodes[b[mine]]))
        if len(found) >= 1000:
            yield _pair_batch(found)
            found = []
    yield _pair_batch(found)


def _pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([none, *(pair[side] for pair in found)])) for side in (0, 1)], ["_a", "_b"])


def _cross_sets(percent: int) -> Callable:
    """Links within each block of a pivot's large buckets; input is sorted by pivot and block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, ["_pivot", "_i", "_j"]):
            if len(cell) < 2:
                continue
            nodes, own = cell.column("_node").to_numpy(), cell.column("_own").to_numpy()
            slots = np.stack([cell.column(c).to_numpy() for c in ("_low", "_high")], axis=1)
            raw = cell.column("_shingles").combine_chunks()
            sets: dict[int, set[int]] = {}
            apart = cell.column("_i")[0] != cell.column("_j")[0]
            found = []
            for a, b, of_a, of_b in _pairs_within(cell):
                slot = first_slot(of_a, of_b)
                # the pair belongs here if the bucket it first shares has this pivot
                mine = (slots[a, slot // 40] >> (slot % 40) & 1) == 1
                if apart:
                    mine &= own[a] != own[b]
                for x, y in zip(a[mine].tolist(), b[mine].tolist(), strict=True):
                    for row in (x, y):
                        if row not in sets:
                            sets[row] = set(np.frombuffer(raw[row].as_buffer(), np.uint64).tolist())
                    common = len(sets[x] & sets[y])
                    if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                        found.append((nodes[x:x + 1], nodes[y:y + 1]))
            yield _pair_batch(found)
    return run


def _sets(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_blocks(whole, 2, 1 << 22):
                sets = shingles(*packed(batch.column(2)), words)
                raw = [s.tobytes() for s in sets]
                right = [xxhash.xxh3_128_digest(r) == name for r, name in zip(raw, batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["_node", "_shingles"]).filter(
                    pa.array(right, pa.bool_()))
    return run


def _confirm(percent: int) -> Callable:
    """Pairs whose whole sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["_a", "_b"]).filter(
                pa.array(good, pa.bool_()))
    return run


def shingle_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(_node, _shingles) of some classes, from the whole text of the smallest document of each."""
    texts = classes.join(nodes.distinct(), "_node").select("_node", "_set", "_first").join(docs, F.col("_first") == F.col("_doc"))
    sets = texts.select("_node", "_set", "_text").mapInArrow(_sets(words), "_node long, _shingles binary")
    return durable(sets.dropDuplicates(["_node"]), "near_sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` that the whole texts bear out, written to the shared folder."""
    sets = shingle_sets(pairs.select(F.explode(F.array("_a", "_b")).alias("_node")), classes, docs, words)
    a = sets.select(F.col("_node").alias("_a"), F.col("_shingles").alias("_of_a"))
    b = sets.select(F.col("_node").alias("_b"), F.col("_shingles").alias("_of_b"))
    both = pairs.join(a, "_a").join(b, "_b").select("_a", "_b", "_of_a", "_of_b")
    return durable(both.mapInArrow(_confirm(percent), "_a long, _b long"), "near_links")


def components(links: DataFrame) -> DataFrame:
    """(_node, _root) for every node of ``links`` (_a, _b); the root is the smallest node reachable.

    Alternating large-star and small-star steps: every node points its larger neighbours,
    then its smaller ones, to the smallest it knows, until nothing changes.
    """
    def edges(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = durable(df.distinct(), "near_edges")
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first())

    links, state = edges(links.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).filter("_a <> _b"))
    while state[0]:
        both = links.unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.least(F.col("_a"), F.min("_b")).alias("_m"))
        large = both.join(least, "_a").filter("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        large = large.filter("_a <> _b").distinct()
        least = large.groupBy("_a").agg(F.min("_b").alias("_m"))
        small = large.join(least, "_a").filter("_b <> _m").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        links, after = edges(small.unionByName(least.select("_a", F.col("_m").alias("_b"))))
        if after == state:
            break
        state = after
    roots = links.select(F.col("_a").alias("_node"), F.col("_b").alias("_root"))
    return durable(roots.unionByName(roots.select(F.col("_root").alias("_node"), "_root")).distinct(), "near_roots")


def _large_links(parts: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components within large buckets."""
    bit = lambda from_: F.bit_or(F.when(F.col("_slot").between(from_, from_ + 39),
                                        F.expr(f"shiftleft(1L, _slot - {from_})")).otherwise(F.lit(0).cast("long")))
    rows = durable(parts.groupBy("_pivot", "_node").agg(
        F.min("_part").alias("_part"), bit(0).alias("_low"), bit(40).alias("_high")), "near_large")
    sets = shingle_sets(rows.select("_node"), classes, docs, words)
    blocks = rows.groupBy("_pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    cells = (
        rows.join(blocks, "_pivot").withColumn("_own", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
        .join(classes.select("_node", "_sign"), "_node").join(sets, "_node")
        .repartition("_pivot", "_i", "_j").sortWithinPartitions("_pivot", "_i", "_j")
        .select("_pivot", "_i", "_j", "_node", "_part", "_own", "_low", "_high", "_sign", "_shingles")
    )
    return durable(cells.mapInArrow(_cross_sets(percent), "_a long, _b long"), "near_large_links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
                    ) -> DataFrame:
    """(key, n_shingles, component_id, kept, text_hash) for every row of ``docs``.

    Documents are linked if their sets of ``words``-word shingles have at least ``percent``
    hundredths of their union in common. Words are runs between ASCII blanks, A-Z counts
    as a-z; a text with fewer words is one shingle. ``component_id`` is the smallest key
    reachable over links, ``kept`` says that it is the row's own.

    Null, empty and blank texts have no shingles and no links; their component is their
    key. Equal texts are one class, however many there are, also if their rows repeat a
    key. A row without a key belongs to its class, but never gives it an id, and a class
    without any key is linked with nothing: its rows have a null component and are kept.
    ``text_hash`` is Spark's xxhash64 of the text, null being empty. Other columns are
    ignored, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(key).alias("_doc"), utf8(text).alias("_text"), text_hash(text).alias("text_hash"))
    out = T.StructType([T.StructField("_doc", docs.schema[key].dataType), T.StructField("text_hash", T.LongType()),
                        T.StructField("n_shingles", T.LongType()),
                        T.StructField("_set", T.BinaryType()), T.StructField("_sign", T.BinaryType())])
    sketch = durable(plain.select("_doc", "_text", "text_hash").mapInArrow(_sketch(words), out), "near_sketch")
    classes = durable(
        sketch.filter("n_shingles > 0").groupBy("_set").agg(F.min("_doc").alias("_first"), F.first("_sign").alias("_sign"))
        .withColumn("_node", F.monotonically_increasing_id()), "near_classes")
    signs = classes.select("_node", "_sign")
    # every class makes SYMBOLS keys: spread the classes first, so that no task holds many of them
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = signs.repartition(width, "_node").mapInArrow(_keys, "_key long, _node long, _slot int")
    buckets = durable(keys.groupBy("_key").agg(F.min("_node").alias("_a"), F.count("*").alias("_n")).filter("_n > 1"),
                      "near_buckets")
    members = durable(keys.join(buckets, "_key"), "near_members")

    sign_of = lambda name: signs.select(F.col("_node").alias(name), F.col("_sign").alias(name + "s"))
    stars = members.select("_a", F.col("_node").alias("_b")).filter("_a <> _b").distinct()
    stars = stars.join(sign_of("_a"), "_a").join(sign_of("_b"), "_b").select("_a", "_b", "_as", "_bs")
    stars = durable(stars.mapInArrow(_near, "_a long, _b long"), "near_stars")
    first = components(confirmed(stars, classes, plain, words, percent))

    part = F.coalesce("_root", "_node")
    parts = members.join(first, "_node", "left").withColumn("_part", part).drop("_root")
    open_ = durable(
        parts.groupBy("_key").agg(F.min("_part").alias("_p"), F.max("_part").alias("_q")).filter("_p <> _q").select("_key"),
        "near_open")
    parts = durable(parts.join(open_, "_key").select("_key", "_node", "_slot", "_n", F.col("_a").alias("_pivot"), "_part"),
                    "near_parts")
    small = (
        parts.filter(F.col("_n") <= SMALL).join(signs, "_node").repartition("_key").sortWithinPartitions("_key")
        .select("_key", "_node", "_part", "_slot", "_sign")
    )
    rest = durable(small.mapInArrow(_cross, "_a long, _b long"), "near_rest")
    links = confirmed(rest, classes, plain, words, percent).unionByName(
        _large_links(parts.filter(F.col("_n") > SMALL), classes, plain, words, percent))
    a, b = (first.select(F.col("_node").alias(n), F.col("_root").alias(n + "r")) for n in ("_a", "_b"))
    joined = components(
        links.join(a, "_a", "left").join(b, "_b", "left")
        .select(F.coalesce("_ar", "_a").alias("_a"), F.coalesce("_br", "_b").alias("_b")))
    second = joined.select(F.col("_node").alias("_root"), F.col("_root").alias("_top"))
    roots = (
        classes.select("_node", "_set", "_first").join(first, "_node", "left").withColumn("_root", part)
        .join(second, "_root", "left").withColumn("_top", F.coalesce("_top", "_root"))
    )
    roots = durable(roots.select("_set", "_first", "_top"), "near_tops")
    smallest = roots.groupBy("_top").agg(F.min("_first").alias("component_id"))
    found = durable(roots.join(smallest, "_top").select("_set", "component_id"), "near_components")
    rows = sketch.select("_doc", "text_hash", "n_shingles", "_set").join(found, "_set", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("_doc")).otherwise(F.col("component_id"))
    return rows.select(
        F.col("_doc").alias(key), "n_shingles", component.alias("component_id"),
        F.col("_doc").eqNullSafe(component).alias("kept"), "text_hash")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
                         ) -> DataFrame:
    """One row of ``docs`` for each component; rows that agree in key and text count as one."""
    found = near_duplicates(docs, words, percent, key, text)
    own, hashed, hash_of_row = (unused(docs.columns, n) for n in ("_key_kept", "_hash_kept", "_hash_of_row"))
    kept = found.filter("kept").select(F.col(key).alias(own), F.col("text_hash").alias(hashed)).distinct()
    rows = docs.withColumn(hash_of_row, text_hash(text)).dropDuplicates([key, hash_of_row])
    return rows.join(
        kept, (F.col(hash_of_row) == F.col(hashed)) & F.col(key).eqNullSafe(F.col(own)), "left_semi").drop(hash_of_row)
