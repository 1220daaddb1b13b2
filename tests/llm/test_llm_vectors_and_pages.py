"""Vector searches and archives against brute force."""

import io
import os
import sys
from collections import defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare, connect  # noqa: E402

from tallyloom.llm import ann, queries, topk, warc  # noqa: E402

NAN, INF = float("nan"), float("inf")
VECTORS = [
    (0, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.5]), (20, [0.0, 1.0, 0.0]), (3, [-1.0, 0.0, 0.0]),
    (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [NAN, 1.0, 0.0]), (8, [INF, 0.0, 0.0]), (9, [None, 1.0, 1.0]),
    (40, [0.25, 0.25]), (41, [0.5, -0.25]), (10, [0.3, 0.3, 0.3]), (10, [0.3, 0.3, 0.3]), (None, [1.0, 1.0, 1.0]),
]


def vectors(spark, rows=VECTORS):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                 "vec_id long, embedding array<float>, score string, rank int")


def brute(rows, queries_, k, kind):
    out = {}
    for q, a in queries_:
        scored = set() if kind == "ann" else []
        for i, b in rows:
            if i != q and len(a) == len(b):
                a64, b64 = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if kind == "ann":
                    scored.add((-(a64 * b64).sum(), i))
                else:
                    scored.append((-int((np.floor(256 * a64) * np.floor(256 * b64)).sum()), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def usable(rows, zero):
    return [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
            and (zero or any(v))]


def answers(df):
    found = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return dict(found)


@pytest.mark.parametrize("block", [8192, 2])
def test_ann_of_awkward_vectors(spark, block):
    """With all buckets probed the search is exact."""
    table = vectors(spark)
    found = answers(ann.search(table.filter("vec_id % 20 = 0"), table, k=4, probes=64, block=block))
    rows = usable(VECTORS, False)
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 4, "ann")
    assert found == {q: v for q, v in expected.items() if v}


def test_ann_recall(spark):
    folder = "/root/testdata/sf0.01"
    found = answers(queries.op4_cross_polytope(spark, folder))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 20, "ann")
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in v}) for q, v in expected.items())
    assert hits / sum(map(len, expected.values())) >= 0.9
    x = dict(rows)
    for q, got in found.items():
        for i, score in got:
            assert abs(score - np.dot(np.float64(x[q]), np.float64(x[i]))) < 1e-12


@pytest.mark.parametrize("size", [1, 2, 15, 21, 40])
def test_ann_gives_all_there_are(spark, size):
    """Tables so small that a query's buckets hold fewer rows than it asks for."""
    rng = np.random.default_rng(size)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(size)] + [(100, [1.0, 2.0]), (120, [2.0, 1.0])]
    table = vectors(spark, rows)
    found = answers(ann.search(table.filter("vec_id % 20 = 0"), table))
    expected = {q: v for q, v in brute(rows, [r for r in rows if r[0] % 20 == 0], 20, "ann").items() if v}
    assert {q: len(v) for q, v in found.items()} == {q: len(v) for q, v in expected.items()}
    if size <= 21:
        assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in expected.items()}


def test_rotation_keeps_angles():
    x = np.random.default_rng(1).normal(size=(20, 13))
    for signs in ann.rotations(13, 3, 1):
        y = ann.rotate(x, signs)
        assert np.allclose(y @ y.T / (x @ x.T), (16.0 ** 3))


@pytest.mark.parametrize("bins", [1024, 3])
def test_topk_of_awkward_vectors(spark, bins):
    table = vectors(spark)
    found = answers(topk.search(table.filter("vec_id % 20 = 0"), table, k=4, bins=bins, block=2))
    rows = usable(VECTORS, True)
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 4, "topk")
    assert found == {q: v for q, v in expected.items() if v}


@pytest.mark.parametrize("together", [1, 3, 100])
def test_topk_of_several_blocks_in_a_pass(spark, together):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(120)]
    found = answers(topk.search(vectors(spark, rows[:50]), vectors(spark, rows).repartition(3), k=6, bins=7, block=9, together=together))
    assert found == brute(rows, rows[:50], 6, "topk")


def test_topk_of_many_ties(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(300)]
    found = answers(topk.search(vectors(spark, rows[:3]), vectors(spark, rows).repartition(5), k=7))
    assert found == brute(rows, rows[:3], 7, "topk")


@pytest.mark.parametrize("large", [3e5, 1e12, 2.0 ** 40 + 3])
def test_topk_of_large_components(spark, large):
    """Components beyond what doubles multiply exactly, next to small ones."""
    rows = [(0, [1.0, 0.0]), (1, [float(np.float32(large)), 0.0]), (2, [1.0, 1.0]), (3, [-float(np.float32(large)), 3.0]),
            (4, [float(np.float32(large)), 1.0]), (5, [0.5, 0.25])]
    expected = brute(rows, rows[:1] + rows[2:3] + rows[5:], 4, "topk")
    found = answers(topk.search(vectors(spark, rows[:1] + rows[2:3] + rows[5:]), vectors(spark, rows).repartition(3), k=4))
    assert found == expected and found[0][0][0] in (1, 4)


def test_topk_products_are_exact():
    rng = np.random.default_rng(3)
    asked, x = rng.integers(-9, 9, (5, 4)).astype(float), rng.integers(-9, 9, (7, 4)).astype(float)
    asked[1] *= 2.0 ** 50
    x[2] *= 2.0 ** 3
    x[5, 0] = 2.0 ** 57
    asked[1, 0] = 1.0
    whole = np.vectorize(int, otypes=[object])
    assert (topk.products(asked, x) == (whole(asked) @ whole(x).T).astype(np.int64)).all()
    with pytest.raises(OverflowError):
        topk.products(np.array([[2.0 ** 40]]), np.array([[2.0 ** 23]]))
    assert topk.products(np.array([[2.0 ** 40]]), np.array([[2.0 ** 22]]))[0, 0] == 1 << 62


def test_topk_of_scores_near_the_ends_of_a_long(spark):
    rows = [(0, [2.0 ** 22]), (1, [11744051.0]), (2, [-11744051.0]), (3, [11744051.0]), (4, [-(2.0 ** 22)]), (5, [0.0])]
    assert answers(topk.search(vectors(spark, rows), vectors(spark, rows), k=4)) == brute(rows, rows, 4, "topk")


def test_sql_agrees(spark, sf_dir):
    for name in ("op10_histogram_topk", "op5_warc"):
        good, text = compare(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)
        assert good, text


def test_no_vectors(spark):
    table = vectors(spark, [])
    assert ann.search(table, table).count() == 0
    assert topk.search(table, table).count() == 0


PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nWARC-Type: evil", "<p>x</p>"), (3, None, None), (4, "u", ""),
         (5, "http://c/ü", "ünï\r\n\r\ncode \U0001F600"), (5, "http://c/ü", "ünï\r\n\r\ncode \U0001F600"),
         (None, "http://d/", "<p>x</p>"), (6, "long", "y" * 300_000), (7, "http://e/", "<p>x</p>")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows],
                                 "page_id long, url string, html string, record_type string, payload_bytes int")


def test_archives_of_awkward_pages(spark, folder):
    path = folder("awkward")
    warc.archive(pages(spark).repartition(3), path)
    rows = sorted((tuple(r) for r in warc.read_pages(spark, path).collect()), key=str)
    digest = lambda t: warc.digest((t or "").encode())
    size = lambda t: len((t or "").encode())
    keeper = {"<p>x</p>": 7, "": 4, None: 4}
    expected = []
    for key, _, html in PAGES:
        to = keeper.get(html)
        again = to is not None and key != to
        expected.append((key, size(html), digest(html), "revisit" if again else "response", to if again else None))
    assert rows == sorted(expected, key=str)


def test_reading_back_payloads_and_headers(spark, folder):
    path = folder("headers")
    warc.archive(pages(spark), path)
    read = spark.read.format("warc").load(path)
    assert read.count() == len(PAGES)
    long = read.filter("record_id = '<urn:page:6>'").select("payload", "target_uri", "headers").first()
    assert bytes(long["payload"]).decode() == "y" * 300_000 and long["headers"]["WARC-Type"] == "response"
    assert read.filter("target_uri LIKE 'http://b/%'").first()["target_uri"] == "http://b/%0D%0AWARC-Type: evil"
    plan = read.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert read.filter("record_type IN ('revisit', 'none')").count() == 4


def test_no_pages(spark, folder):
    path = folder("none")
    warc.archive(pages(spark, []), path)
    assert warc.read_pages(spark, path).count() == 0


def test_least_bytes(spark):
    kinds = {r["record_id"]: r["record_type"] for r in warc.captures(pages(spark), least_bytes=1).collect()}
    assert kinds["<urn:page:3>"] == "response" and kinds["<urn:page:1>"] == "revisit"


class Source(io.BytesIO):
    """Counts the bytes that are read."""

    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


@pytest.mark.parametrize("kind", ["told", "foreign", "plain"])
def test_records_of_any_writer(kind):
    import gzip
    body = [warc.record("response", f"<urn:page:{i}>", "u", "d", bytes([i]) * 200_000, warc.digest(bytes([i]) * 200_000),
                        200_000, None) for i in range(5)]
    pack = {"told": warc.member, "foreign": gzip.compress, "plain": lambda x: x}[kind]
    raw = b"".join(map(pack, body))
    rows = list(warc.records(Source(raw), kind != "plain", warc._Wanted([]), True))
    assert [r["payload"] for r in rows] == [bytes([i]) * 200_000 for i in range(5)]
    some = Source(raw)
    rows = list(warc.records(some, kind != "plain", warc._Wanted([("record_id", "in", ("<urn:page:3>",))]), False))
    assert [r["record_id"] for r in rows] == ["<urn:page:3>"] and rows[0]["payload"] is None
    if kind == "plain":
        assert some.total < 60_000


def test_wrong_digest_is_found():
    bad = warc.record("response", "<urn:page:1>", "u", "d", b"body", warc.digest(b"other"), 4, None)
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(Source(bad), False, warc._Wanted([]), True))


def test_archives_are_written_where_spark_says(spark, folder):
    """Addresses as Spark resolves them; a store that workers cannot open is refused before anything runs."""
    path = folder("address")
    warc.archive(pages(spark), f"file:{path}")
    assert warc.read_pages(spark, path).count() == len(PAGES) == spark.read.format("warc").load(f"file:{path}").count()
    with pytest.raises(Exception, match="viewfs|No FileSystem|mount"):
        warc.archive(pages(spark), "viewfs://nowhere/in")
