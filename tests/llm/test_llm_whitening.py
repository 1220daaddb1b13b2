"""Whitening against exact polynomials and a plain eigenvalue routine."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm import queries, whitening

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows],
                                 "vec_id long, embedding array<float>, n string, whitened double")


def plain_polynomial(m):
    """Faddeev and LeVerrier's recursion in integers."""
    d = len(m)
    coefs, step = [0] * d + [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        step = m.dot(step) + coefs[d - k + 1] * np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        coefs[d - k] = -int(np.trace(m.dot(step))) // k
    return coefs


def gram(rows):
    a = np.array(rows, object)
    return a.T.dot(a)


RNG = np.random.default_rng(5)
MATRICES = [
    gram(RNG.integers(-9, 9, (20, 6)).tolist()), gram(RNG.integers(-(1 << 40), 1 << 40, (9, 5)).tolist()),
    gram([[1, 2, 3], [2, 4, 6]]), gram([[3, 0, 0], [0, 3, 0], [0, 0, 3], [0, 0, 1]]), gram([[5]]),
    gram([[1 << 30, 1], [0, 1]]), np.diag(np.array([4, 4, 4, 1, 0], object)),
]


@pytest.mark.parametrize("m", MATRICES)
def test_characteristic_polynomial_is_exact(spark, m):
    assert whitening.characteristic_polynomial(spark, m) == plain_polynomial(m)


def test_roots_are_isolated_whatever_their_multiplicity():
    from functools import reduce
    roots = [0, 0, 3, 3, 3, 7, 7 + (1 << 20)]
    coefs = reduce(lambda c, r: [a - r * b for a, b in zip([0, *c], [*c, 0], strict=True)], roots, [1])
    assert whitening.roots_above(coefs, 3, 0) == 2 and whitening.roots_above(coefs, 5, 1) == 5
    found = whitening.largest_roots(coefs, 7, sum(roots))
    assert [Fraction(r, 1 << whitening.DEEP) for r in found] == sorted(roots, reverse=True)
    near = reduce(lambda c, r: [a * (1 << 60) - r * b for a, b in zip([0, *c], [*c, 0], strict=True)], [1 << 60, (1 << 60) + 1], [1])
    top = whitening.largest_roots([c for c in near], 2, 2)
    assert [Fraction(r, 1 << whitening.DEEP) for r in top] == [1 + Fraction(1, 1 << 60), 1]


def brute(rows, components=4):
    """Rows per id from numpy's eigenvalues, one space per length."""
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for dim in {len(x) for _, x in kept if len(x)}:
        fit = np.unique([x for _, x in kept if len(x) == dim], axis=0)
        n, mean = len(fit), fit.mean(axis=0)
        values, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
        order = np.argsort(-values)[:components]
        for i, x in kept:
            if len(x) == dim:
                centred = (x - mean) @ axes[:, order] / np.sqrt(np.maximum(values[order], 1e-9))
                y = n * x - fit.sum(axis=0)
                out[i] = n, int((y * y).sum()), centred, values[order] / max(values.sum(), 1e-9)
    return out


def held(df, rows):
    expected, found = brute(rows), {}
    for r in df.collect():
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(found) == set(expected)
    signs = {}
    for i, (n, deviation, centred, explained) in expected.items():
        assert sorted(found[i]) == list(range(1, len(centred) + 1))
        for c, r in found[i].items():
            assert (r["n"], r["deviation"]) == (n, deviation)
            if explained[c - 1] < 1e-9:
                assert r["whitened"] is None
                continue
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9) and r["identity_error"] < 1e-9
            if abs(centred[c - 1]) > 1e-6:
                sign = signs.setdefault((len(centred), n, c), np.sign(r["whitened"] * centred[c - 1]))
                assert r["whitened"] == pytest.approx(sign * centred[c - 1], rel=1e-6, abs=1e-6)
    return found


def test_whitened_awkward_vectors(spark):
    rows = [(i, RNG.normal(size=6).astype(np.float32).tolist()) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, []), (104, [NAN] + [1.0] * 5), (105, [INF] * 6),
             (106, [None] + [1.0] * 5), (107, [0.0] * 6), (108, [-0.0] * 6), (109, [1.0, 2.0]), (110, [0.5, -3.0]), (111, [0.25, 1.0]),
             (112, [7.0])]
    found = held(whitening.whiten(table(spark, rows)), rows)
    assert found[100][1]["whitened"] == found[0][1]["whitened"] and found[107][2] is not None
    assert [r["whitened"] for r in found[112].values()] == [None]
    with_null = whitening.whiten(table(spark, [*rows, (None, rows[1][1]), (0, rows[0][1])]))
    assert with_null.filter("vec_id is null").count() == 4 and with_null.filter("vec_id = 0").count() == 8


def test_flat_directions_have_no_value(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0, 0.0, 5.0]) for i in range(30)]
    found = held(whitening.whiten(table(spark, rows)), rows)
    assert found[0][1]["explained"] == 1.0 and found[0][2]["explained"] == 0.0


def test_equal_variances_get_orthogonal_components(spark):
    rows = [(8 * i + 2 * j + k, [(1.0 if k else -1.0) * (j == c) for c in range(4)]) for i in range(2) for j in range(4) for k in range(2)]
    out = whitening.whiten(table(spark, rows)).toPandas()
    assert out["identity_error"].max() < 1e-12 and np.allclose(out["explained"], 0.25)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(v)) for v in (1e9 * (i % 7 + 1), -3e8 * (i % 3), i)]) for i in range(21)]
    fit = whitening.quantized(table(spark, rows), "vec_id", "embedding")
    n, sums, scatter = whitening.moments(fit)[3]
    x = np.array([r["_x"] for r in fit.collect()], object)
    s = np.array(sums, object)
    assert n == 21 and sums == x.sum(axis=0).tolist() and (scatter == n * x.T.dot(x) - s[:, None] * s).all()
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whiten(table(spark, rows)).collect()


def test_whitening_of_nothing(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []


def test_whitening_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    held(queries.QUERIES["op12_whitening"](spark, sf_dir), rows)
