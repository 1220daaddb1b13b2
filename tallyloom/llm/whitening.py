"""Whitening of embeddings from an exact characteristic polynomial.

Vectors become whole numbers, so their scatter n * sum(x x') - S S' is a matrix of integers,
added up without rounding. Its characteristic polynomial is found modulo many primes by
Hessenberg reduction, one prime a row of a Spark job, and put together by the Chinese
remainder theorem. All its roots are real, so Descartes' rule counts those above any number
exactly: bisection isolates the largest ones to some 60 digits. Components are null vectors
of the scatter minus a root, by inverse iteration in decimals of as many digits.

What the driver holds is a matrix of the vectors' length squared, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import durable
from .vectors import usable

#: Bits behind the point of an isolated root, and of one limb of a sum.
DEEP, LIMB = 192, 32
#: A limb of a component in an exact product of doubles, and rows of such a product.
_SPLIT, _ROWS = 17, 1 << 17


def quantized(table: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(_id, _dim, _x) of vectors without null or non-finite components: _x is floor(scale * x) as longs."""
    whole = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    return table.filter(F.coalesce(usable(F.col(vector), True), F.lit(False))).select(
        F.col(key).cast("long").alias("_id"), F.size(vector).alias("_dim"), whole.alias("_x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(rows, length, matrix of longs) for the lengths in each batch of (_dim, _x, ...)."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            dims = part.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = part.take(pa.array(np.flatnonzero(dims == dim)))
                yield rows, int(dim), rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dim))


def _gram(x: np.ndarray) -> np.ndarray:
    """Exact x' x as Python integers: products of limbs stay below 2**53."""
    if not len(x) or max(int(x.max()), -int(x.min())) < 1 << _SPLIT:
        limbs = [x]
    else:
        low = (1 << _SPLIT) - 1
        limbs = [x & low, (x >> _SPLIT) & low, (x >> 2 * _SPLIT) & low, x >> 3 * _SPLIT]
    parts = [limb.astype(np.float64) for limb in limbs]
    total = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total = total + ((a.T @ b).astype(np.int64).astype(object) << _SPLIT * (i + j))
    return total


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, limb) of a whole number; sums of limbs of one place are limbs of the sum."""
    place = 0
    while not -(1 << LIMB - 1) <= value < 1 << LIMB - 1:
        yield place, value & (1 << LIMB) - 1
        value >>= LIMB
        place += 1
    yield place, value


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count (entry -1), sums (0 to d - 1) and products (d + i * d + j, i <= j) of a task's vectors, in limbs."""
    totals: dict[int, list] = {}
    for _, dim, x in _matrices(batches):
        own = totals.setdefault(dim, [0, np.zeros(dim, object), np.zeros((dim, dim), object)])
        own[0] += len(x)
        own[1] = own[1] + x.astype(object).sum(axis=0)
        own[2] = own[2] + _gram(x)
    out = []
    for dim, (n, sums, products) in totals.items():
        named = [(-1, n), *enumerate(sums), *((dim + i * dim + j, products[i, j]) for i in range(dim) for j in range(i, dim))]
        out += [(dim, entry, place, limb) for entry, value in named for place, limb in limbs(int(value))]
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
        ["_dim", "_entry", "_place", "_limb"])


def moments(fit: DataFrame) -> dict[int, tuple[int, list[int], np.ndarray]]:
    """Exact (n, S, scatter n * sum(x x') - S S') of every vector length."""
    sums = fit.select("_dim", "_x").mapInArrow(_moments, "_dim int, _entry long, _place int, _limb long")
    values: dict[int, dict[int, int]] = {}
    # at most a few limbs for every pair of components
    for dim, entry, place, limb in sums.groupBy("_dim", "_entry", "_place").agg(F.sum("_limb")).collect():
        own = values.setdefault(dim, {})
        own[entry] = own.get(entry, 0) + (limb << LIMB * place)
    found = {}
    for dim, own in values.items():
        n, s = own[-1], [own[i] for i in range(dim)]
        scatter = np.zeros((dim, dim), object)
        for i in range(dim):
            for j in range(i, dim):
                scatter[i, j] = scatter[j, i] = n * own[dim + i * dim + j] - s[i] * s[j]
        found[dim] = n, s, scatter
    return found


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these witnesses are certain below 2**32."""
    if any(n % q == 0 for q in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd = n - 1
    twos = (odd & -odd).bit_length() - 1
    for witness in (2, 3, 5, 7):
        x = pow(witness, odd >> twos, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(product: int) -> list[int]:
    """Primes below 2**31, the largest first, until their product exceeds the given one."""
    found, total, n = [], 1, (1 << 31) - 1
    while total <= product:
        if _is_prime(n):
            found.append(n)
            total *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo a prime, constant first, by Hessenberg reduction."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(1, d - 1):
        pivots = np.flatnonzero(h[k:, k - 1])
        if not len(pivots):
            continue
        r = k + int(pivots[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        factor = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * factor % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        chain, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            chain[i - 1] = below * int(h[i - 1, k - 1]) % p
        chain[k - 1] = h[k - 1, k - 1]
        polys[k] = (np.roll(polys[k - 1], 1) - (chain[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d]


def _residues(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int64()), pa.array([polynomial_modulo(shared.value, p).tolist()], pa.list_(pa.int64()))],
                    ["p", "residues"])
    return run


def characteristic_polynomial(spark: SparkSession, scatter: np.ndarray) -> list[int]:
    """Exact coefficients of det(x - scatter), constant first; the scatter has no negative eigenvalue."""
    d, trace = len(scatter), int(np.trace(scatter))
    # symmetric functions of nonnegative numbers are largest where all numbers are equal
    bound = max(math.comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))
    rows = spark.createDataFrame([(p,) for p in primes(2 * bound)], "p long")
    modulo = {r["p"]: r["residues"] for r in rows.mapInArrow(
        _residues(spark.sparkContext.broadcast(scatter)), "p long, residues array<long>").collect()}
    found, product = [0] * (d + 1), 1
    for p, residues in modulo.items():
        inverse = pow(product, -1, p)
        found = [c + product * ((r - c) * inverse % p) for c, r in zip(found, residues, strict=True)]
        product *= p
    return [c - product if 2 * c > product else c for c in found]


def roots_above(coefs: list[int], a: int, s: int) -> int:
    """How many roots exceed a / 2**s, by Descartes' rule; exact, as all roots are real."""
    d = len(coefs) - 1
    c = [x << s * (d - k) for k, x in enumerate(coefs)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(coefs: list[int], a: int, s: int) -> int:
    """Sign of the polynomial at a / 2**s."""
    value, d = 0, len(coefs) - 1
    for k in range(d, -1, -1):
        value = value * a + (coefs[k] << s * (d - k))
    return (value > 0) - (value < 0)


def largest_roots(coefs: list[int], many: int, top: int) -> list[int]:
    """The ``many`` largest roots as multiples of 2**-DEEP, rounded up; all lie in [0, top]."""
    positive = len(coefs) - 1 - next(k for k, c in enumerate(coefs) if c)
    found: list[int] = []
    for j in range(1, many + 1):
        if j > positive:
            found.append(0)
            continue
        lo, hi, s, above, below = 0, top, 0, 0, positive
        while below - above > 1 and (s < DEEP or hi - lo > 1):
            if hi - lo == 1:
                lo, hi, s = 2 * lo, 2 * hi, s + 1
            mid = (lo + hi) >> 1
            count = roots_above(coefs, mid, s)
            if count >= j:
                lo, below = mid, count
            else:
                hi, above = mid, count
        sign = -1 if above % 2 else 1
        while s < DEEP or hi - lo > 1:
            if hi - lo == 1:
                lo, hi, s = 2 * lo, 2 * hi, s + 1
            mid = (lo + hi) >> 1
            # right of the only root the sign is that of the roots above
            if _sign(coefs, mid, s) == -sign:
                lo = mid
            else:
                hi = mid
        found.append(hi)
    return found


def null_vectors(scatter: np.ndarray, roots: list[int]) -> list[np.ndarray]:
    """Unit vectors for the given roots by inverse iteration in decimals; equal roots get orthogonal ones."""
    d = len(scatter)
    found: list[list[Decimal]] = []
    with localcontext() as context:
        context.prec = 2 * len(str(max(roots))) + 20
        dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), Decimal(0))
        for number, root in enumerate(roots):
            shift = Decimal(root) / Decimal(1 << DEEP)
            a = [[Decimal(int(v)) - (shift if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(scatter)]
            tiny = (max(abs(v) for row in a for v in row) or Decimal(1)).scaleb(-context.prec)
            order = list(range(d))
            for k in range(d):
                r = max(range(k, d), key=lambda i: abs(a[i][k]))
                a[k], a[r], order[k], order[r] = a[r], a[k], order[r], order[k]
                if not a[k][k]:
                    a[k][k] = tiny
                pivot = a[k]
                for row in a[k + 1:]:
                    if row[k]:
                        f = row[k] = row[k] / pivot[k]
                        row[k + 1:] = [x - f * y for x, y in zip(row[k + 1:], pivot[k + 1:], strict=True)]
            same = [found[i] for i in range(number) if abs(roots[i] - root) <= 2]
            v = [Decimal(1 + (7 * (i + 1) * (number + 3)) % 11) for i in range(d)]
            for _ in range(3):
                v = [v[i] for i in order]
                for i in range(d):
                    v[i] -= dot(a[i][:i], v[:i])
                for i in range(d - 1, -1, -1):
                    v[i] = (v[i] - dot(a[i][i + 1:], v[i + 1:])) / a[i][i]
                for _ in range(2):
                    for other in same:
                        along = dot(v, other)
                        v = [x - along * y for x, y in zip(v, other, strict=True)]
                    length = dot(v, v).sqrt()
                    v = [x / length for x in v]
            if max(v, key=abs) < 0:
                v = [-x for x in v]
            found.append(v)
    return [np.array([float(x) for x in v]) for v in found]


@dataclass
class Space:
    """Whitening of vectors of one length: whitened = (n x - S) @ axes; a direction without variance has no axis."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float | None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they suffice, Python integers beyond."""
        most = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums))
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) @ self.axes.T


def _deviation(y: np.ndarray) -> np.ndarray:
    """Sum of squares of each row as a long; an error if it is none."""
    most = max(int(y.max(initial=0)), -int(y.min(initial=0)))
    if most * most * max(y.shape[1], 1) < 1 << 63:
        return (y.astype(np.int64) ** 2).sum(axis=1)
    exact = (y.astype(object) ** 2).sum(axis=1)
    if max(exact) >= 1 << 63:
        raise OverflowError(f"a deviation of {max(exact)} does not fit a long")
    return exact.astype(np.int64)


def solve(spark: SparkSession, n: int, sums: list[int], scatter: np.ndarray, components: int) -> Space:
    """The whitening of one vector length from its exact moments."""
    trace, many = int(np.trace(scatter)), min(components, len(scatter))
    if not trace:
        return Space(n, sums, np.full((many, len(scatter)), np.nan), [None] * many)
    roots = largest_roots(characteristic_polynomial(spark, scatter), many, trace)
    axes = np.full((many, len(scatter)), np.nan)
    positive = [r for r in roots if r]
    for i, v in enumerate(null_vectors(scatter, positive)):
        axes[i] = v / math.sqrt(positive[i] / (1 << DEEP))
    return Space(n, sums, axes, [r / (trace << DEEP) for r in roots])


def _products(shared) -> Callable:
    """Sums and products of whitened vectors of the fit list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for _, dim, x in _matrices(batches):
            space: Space = shared.value[dim]
            w = space.whiten(space.centred(x))
            w = np.c_[np.ones(len(w)), w]
            totals[dim] = totals.get(dim, 0) + w.T @ w
        out = [(dim, i, j, float(t[i, j])) for dim, t in totals.items() for i in range(len(t)) for j in range(len(t))]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)],
            ["_dim", "_i", "_j", "_v"])
    return run


def identity_error(fit: DataFrame, spaces: dict[int, Space]) -> float | None:
    """Largest absolute entry of whitened's covariance over the fit list minus the identity; null without variance."""
    shared = fit.sparkSession.sparkContext.broadcast(spaces)
    sums = fit.select("_dim", "_x").mapInArrow(_products(shared), "_dim int, _i int, _j int, _v double")
    entries: dict[int, np.ndarray] = {d: np.zeros((len(s.axes) + 1,) * 2) for d, s in spaces.items()}
    for dim, i, j, v in sums.groupBy("_dim", "_i", "_j").agg(F.sum("_v")).collect():
        entries[dim][i, j] = v
    worst: list[float] = []
    for dim, t in entries.items():
        n, good = spaces[dim].n, ~np.isnan(spaces[dim].axes[:, 0])
        mean = t[0, 1:] / n
        cov = (t[1:, 1:] / n - np.outer(mean, mean))[good][:, good]
        worst += [float(np.abs(cov - np.eye(len(cov))).max())] if good.any() else []
    return max(worst, default=None)


def _rows(shared, error: float | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, dim, x in _matrices(batches):
            space: Space = shared.value[dim]
            centred = space.centred(x)
            white, many, n = space.whiten(centred), len(space.axes), len(x)
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays(
                [rows.column(2).take(pa.array(np.repeat(np.arange(n), many))),
                 pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), n)), pa.array(np.full(n * many, space.n)),
                 pa.array(np.repeat(_deviation(centred), many)), pa.array(flat, mask=np.isnan(flat)),
                 pa.array(space.explained * n, pa.float64()), pa.array([error] * (n * many), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(table: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Every vector in the ``components`` directions of most variance, scaled to unit variance.

    Components of vectors become x = floor(scale * c), the nearest long beyond longs. Null
    vectors and those with null or non-finite components are left out; empty ones have no
    component. Mean and covariance are those of the distinct x, each once, with divisor n;
    vectors of each length are a space of their own. Returns a row per row of the table and
    component: vec_id (null if it is), component (from 1), n, deviation (squared length of
    n x - S, an error if beyond a long), whitened (null in a direction without variance),
    explained (null if nothing varies) and identity_error, one value. Repeated rows are
    answered each; an empty table gives no rows. Vectors of length d cost the driver
    d**3 operations per component, and one Spark task d**3 per prime.
    """
    spark = table.sparkSession
    rows = quantized(table, key, vector, scale)
    fit = durable(rows.select("_dim", "_x").distinct(), "whitening_fit")
    spaces = {dim: solve(spark, *found, components) for dim, found in moments(fit).items()}
    error = identity_error(fit, spaces)
    return rows.select("_dim", "_x", "_id").mapInArrow(
        _rows(spark.sparkContext.broadcast(spaces), error),
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
