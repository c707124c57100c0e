"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers ``x = floor(64 c) + 1000000``, so the scatter ``A = n * sum(x x') - S S'`` (``n ** 2`` times the
covariance) is an integer matrix, and every step up to the components is exact or of stated precision:

* tasks sum products of small digits, which double precision holds exactly, and Spark adds the sums;
* the characteristic polynomial of ``A`` is computed modulo as many 31-bit primes as a bound on its coefficients
  needs: Hessenberg reduction and its recurrence for all primes of a task at once, Chinese remainders at the end;
* all roots are real, so the sign changes of the polynomial shifted to ``a`` count the roots above ``a``; halving
  by these counts isolates each root, and halving by the exact sign brings it to ``BITS`` bits. Roots that
  agree to all these bits are one root of higher multiplicity; zeros are counted by the lowest coefficients;
* a component is the null vector of ``A - root``: elimination and inverse iteration in fixed point of ``2 * BITS`` bits,
  one task a root. A root of multiplicity m gets m orthonormal vectors.

What passes the driver is the matrix, the polynomial and the components: their size follows the dimensions only.
The two passes over the vectors, and the output, shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm.vectors import doubles, finite, matrix

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
DIGIT = 13
BITS = 128
LARGE = 10**18
#: entries of ``floor(64 c)`` are kept below this size, as a cast to long would
FAR = float(1 << 61)
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _entries(column: pa.Array, dims: int) -> np.ndarray:
    """``x - SHIFT`` as int64."""
    return np.clip(np.floor(SCALE * matrix(column, dims)), -FAR, FAR).astype(np.int64)


def gram(y: np.ndarray) -> list[list[int]]:
    """The exact ``y' y`` of an integer matrix as Python integers."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for at in range(0, len(y), 1 << 16):
        rest, digits = y[at : at + (1 << 16)], []
        while np.abs(rest).max(initial=0) >= 1 << DIGIT:
            digits.append((rest & ((1 << DIGIT) - 1)).astype(float))
            rest = rest >> DIGIT
        digits.append(rest.astype(float))
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total += (a.T @ b).astype(np.int64).astype(object) << (DIGIT * (i + j))
    return total.tolist()


def scatter(vectors: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of ``x - SHIFT`` and the matrix ``n ** 2 * covariance``, all exact."""
    low, high = np.tril_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            y = _entries(b.column("vector"), dims)
            n += len(y)
            products = products + np.array(gram(y), object)
            sums = sums + y.astype(object).sum(axis=0) if len(y) else sums
        flat = [n, *sums.tolist(), *products[low, high].tolist()]
        high_part, low_part = zip(*(divmod(v, LARGE) for v in flat), strict=True)
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(flat)), pa.int32()), *[pa.array([Decimal(v) for v in part], kind) for part in (high_part, low_part)]], ["i", "high", "low"]
        )

    parts = vectors.select("vector").mapInArrow(run, "i int, high decimal(38,0), low decimal(38,0)")
    sums = parts.groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    flat = [0] * (1 + dims + len(low))
    for r in sums:
        flat[r["i"]] = int(r["high"]) * LARGE + int(r["low"])
    n, s = flat[0], flat[1 : dims + 1]
    a = [[0] * dims for _ in range(dims)]
    for i, j, g in zip(low.tolist(), high.tolist(), flat[dims + 1 :], strict=True):
        a[i][j] = a[j][i] = n * g - s[i] * s[j]
    return n, s, a


# --- characteristic polynomial ---------------------------------------------------------------------------


def _is_prime(p: int) -> bool:
    return all(p % q for q in range(2, isqrt(p) + 1))


def primes(bits: int) -> list[int]:
    """Primes below ``2 ** 31``, largest first, whose product has more than ``bits`` bits."""
    found, product, p = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits + 1:
        if _is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def bound(a: list[list[int]]) -> int:
    """No coefficient of the characteristic polynomial is larger: the roots are not negative and sum to the trace."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    return max(-(-comb(d, k) * trace**k // d**k) for k in range(d + 1)) if d else 1


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``a ** (p - 2) mod p``, which inverts ``a``, for many primes at once; zero stays zero."""
    out, base, e = np.ones_like(a), a % p, p - 2
    while e.any():
        out = np.where(e & 1, out * base % p, out)
        base = base * base % p
        e = e >> 1
    return out


def polynomial_mod(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients (lowest first) of the characteristic polynomials of ``h[i]`` modulo ``p[i]``: (primes, d + 1)."""
    count, d, _ = h.shape
    h, each, p1, p2 = h.copy(), np.arange(count), p[:, None], p[:, None, None]
    for m in range(d - 2):  # column m below the diagonal: one entry stays
        pivot = m + 1 + np.argmax(h[:, m + 1 :, m] != 0, axis=1)
        for axis in (1, 2):  # the same exchange of rows and of columns
            rows = h if axis == 1 else h.transpose(0, 2, 1)
            one, two = rows[each, pivot].copy(), rows[each, m + 1].copy()
            rows[each, m + 1], rows[each, pivot] = one, two
        u = h[:, m + 2 :, m] * _inverse(h[:, m + 1, m], p)[:, None] % p1
        h[:, m + 2 :, :] = (h[:, m + 2 :, :] - u[:, :, None] * h[:, None, m + 1, :] % p2) % p2
        h[:, :, m + 1] = (h[:, :, m + 1] + (h[:, :, m + 2 :] * u[:, None, :] % p2).sum(axis=2)) % p1
    poly = np.zeros((d + 1, count, d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(d):
        new = np.zeros((count, d + 1), np.int64)
        new[:, 1:] = poly[k, :, :-1]
        new = (new - h[:, k, k, None] * poly[k] % p1) % p1
        chain = np.ones(count, np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            new = (new - (h[:, i, k] * chain % p)[:, None] * poly[i] % p1) % p1
        poly[k + 1] = new
    return poly[d]


def polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Coefficients of ``det(t - a)``, lowest first, exact; the primes are dealt over tasks."""
    d = len(a)
    chosen = primes(bound(a).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.array(a, object).reshape(d, d)
        for b in batches:
            p = np.array([chosen[i] for i in b.column("id").to_pylist()], np.int64)
            for at in range(0, len(p), 16):
                some = p[at : at + 16]
                h = np.stack([(entries % int(q)).astype(np.int64) for q in some])
                found = polynomial_mod(h, some)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found.tolist(), pa.list_(pa.int64()))], ["p", "c"])

    slices = min(len(chosen), max(1, spark.sparkContext.defaultParallelism))
    found = {r["p"]: r["c"] for r in spark.range(0, len(chosen), 1, slices).mapInArrow(run, "p long, c array<long>").collect()}
    value, product = [0] * (d + 1), 1
    for p in chosen:
        inverse = pow(product, -1, p)
        value = [v + product * ((c - v) * inverse % p) for v, c in zip(value, found[p], strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in value]


# --- roots -----------------------------------------------------------------------------------------------


def _above(c: list[int], num: int, bits: int) -> int:
    """How many roots lie above ``num / 2 ** bits``: sign changes of the shifted polynomial, all roots being real."""
    d = len(c) - 1
    q = [v << (bits * (d - i)) for i, v in enumerate(c)]  # the polynomial of 2 ** bits * t
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            q[j] += num * q[j + 1]
    signs = [v > 0 for v in q if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(c: list[int], num: int, bits: int) -> int:
    """Sign at ``num / 2 ** bits``."""
    v = 0
    for i, x in enumerate(reversed(c)):
        v = v * num + (x << (bits * i))
    return (v > 0) - (v < 0)


def roots(c: list[int]) -> list[tuple[int, int, int]]:
    """Positive roots, largest first, as (numerator, bits, multiplicity): each within two units of ``numerator / 2 ** bits``.

    ``bits`` is the same for all and gives the smallest root at least ``BITS`` binary places. An interval that still
    holds several roots when it is that narrow is one root of that multiplicity.
    """
    zeros = next(i for i, v in enumerate(c) if v)
    c = c[zeros:]
    d = len(c) - 1
    if not d:
        return []
    top = 1
    while _above(c, top, 0):
        top *= 2
    least = (abs(c[1]) // abs(c[0])).bit_length() + 1  # the smallest root is at least |c0 / c1|
    bits = BITS + least
    found: list[tuple[int, int, int]] = []
    todo = [(0, top << bits, d, 0)]
    while todo:
        low, high, above_low, above_high = todo.pop()
        k = above_low - above_high
        if not k:
            continue
        if high - low <= 2:
            found.append(((low + high) // 2, bits, k))
            continue
        if k == 1:  # alone: the exact sign halves
            at_high = _sign(c, high, bits)
            if not at_high:
                low = high
            while high - low > 2:
                middle = (low + high) // 2
                s = _sign(c, middle, bits)
                if not s:
                    low = high = middle
                elif s == at_high:
                    high = middle
                else:
                    low = middle
            found.append(((low + high) // 2, bits, 1))
            continue
        middle = (low + high) // 2
        shift = (middle & -middle).bit_length() - 1 if middle else 0  # fewer bits while the interval is wide
        shift = min(shift, bits)
        here = _above(c, middle >> shift, bits - shift)
        todo += [(low, middle, above_low, here), (middle, high, here, above_high)]
    return sorted(found, reverse=True)


# --- components ------------------------------------------------------------------------------------------


def null_vectors(a: list[list[int]], num: int, bits: int, multiplicity: int) -> list[list[float]]:
    """Orthonormal null vectors of ``a - num / 2 ** bits`` by elimination and two inverse iterations in fixed point.

    The numbers have ``2 * BITS`` binary places below the largest entry. Pivots are the largest entries left, so
    the smallest stand last; the last ``multiplicity`` unknowns are free in turn.
    """
    d = len(a)
    size = max(1, max(abs(v) for row in a for v in row)).bit_length()
    places = max(2 * BITS, size + BITS)
    one = 1 << places
    scaled = lambda v: v << (places - size) if places >= size else v >> (size - places)
    root = num << (places - size) >> bits if places >= size else num >> (bits + size - places)
    m = np.array([[scaled(v) for v in row] for row in a], object)
    for i in range(d):
        m[i, i] -= root
    rows, cols = list(range(d)), list(range(d))
    lower = np.zeros((d, d), object)
    for k in range(d):
        rest = np.abs(m[k:, k:])
        i, j = divmod(int(np.argmax(rest)), d - k)
        m[[k, k + i]], lower[[k, k + i]] = m[[k + i, k]], lower[[k + i, k]]
        rows[k], rows[k + i] = rows[k + i], rows[k]
        m[:, [k, k + j]] = m[:, [k + j, k]]
        cols[k], cols[k + j] = cols[k + j], cols[k]
        if not m[k, k]:
            m[k, k] = 1  # exactly singular: the least unit stands for zero
        f = (m[k + 1 :, k] << places) // m[k, k]
        lower[k + 1 :, k] = f
        m[k + 1 :, k:] = m[k + 1 :, k:] - ((f[:, None] * m[None, k, k:]) >> places)

    def solve(b: np.ndarray) -> np.ndarray:
        v = b[rows].copy()
        for k in range(d):
            v[k + 1 :] = v[k + 1 :] - ((lower[k + 1 :, k] * v[k]) >> places)
        for k in range(d - 1, -1, -1):
            v[k] = (v[k] << places) // m[k, k]
            v[:k] = v[:k] - ((m[:k, k] * v[k]) >> places)
        out = np.zeros(d, object)
        out[cols] = v
        return out

    def unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        largest = max(abs(x) for x in v)
        v = (v << places) // (largest or 1)
        for _ in range(2):
            for o in others:
                v = v - ((o * (int((v * o).sum()) >> places)) >> places)
        length = isqrt(int((v * v).sum()))
        return (v << places) // (length or 1)

    found: list[np.ndarray] = []
    for t in range(multiplicity):
        v = np.zeros(d, object)  # the free unknowns in turn, seen from the elimination's last rows
        v[rows[d - 1 - t]] = one
        for i in range(d):
            v[i] += one >> (8 + (i + t) % 5)
        for _ in range(3):
            v = unit(solve(v), found)
        found.append(v)
    half = places - 60
    vectors = [[float(int(x) >> half) / (1 << 60) for x in v] for v in found]
    return [[-x for x in v] if v[max(range(d), key=lambda i: (abs(v[i]), -i))] < 0 else v for v in vectors]


def components(spark: SparkSession, a: list[list[int]], count: int) -> list[tuple[float, list[float]]]:
    """((numerator, bits) of the root, unit vector) of the largest roots, at most ``count``, zeros left out; one task a root."""
    found, left = [], count
    for num, bits, k in roots(polynomial(spark, a)):
        if left > 0:
            found.append((num, bits, min(k, left), k))
            left -= k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                num, bits, take, k = found[i]
                for t, v in enumerate(null_vectors(a, num, bits, k)[:take]):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t]), pa.array([v], pa.list_(pa.float64()))], ["i", "t", "v"])

    if not found:
        return []
    made = spark.range(0, len(found), 1, len(found)).mapInArrow(run, "i long, t long, v array<double>").collect()
    return [(found[r["i"]][:2], list(r["v"])) for r in sorted(made, key=lambda r: (r["i"], r["t"]))]


# --- whitening -------------------------------------------------------------------------------------------


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) for every vector and component.

    Vectors that are null or hold a null or a value that is not finite are left out; a null key stays null, and
    repeated rows are rows of their own. Shorter vectors count as padded with zeros, and entries beyond the range
    of long as its ends. Components are numbered from 1 by falling eigenvalue; those without variance (copies
    of one row, fewer rows than dimensions) are left out, so a table of one row, or an empty one, gives no rows.
    ``deviation`` is exact; ``whitened`` has variance 1 over the table; ``identity_error`` is measured from the whitened
    values themselves. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), doubles(df, vector).alias("vector")).where(finite(F.col("vector")))
    dims = rows.agg(F.max(F.size("vector")).alias("d")).first()["d"]
    if not dims:
        return spark.createDataFrame([], OUT)
    n, sums, a = scatter(rows, dims)
    found = components(spark, a, count)
    if not found:
        return spark.createDataFrame([], OUT)
    trace = sum(a[i][i] for i in range(dims))
    # a root of the scatter is n ** 2 times an eigenvalue
    over = np.array([float(np.sqrt(_ratio(num, trace << bits)) * np.sqrt(_ratio(trace, n * n))) for (num, bits), _ in found])
    share = np.array([_ratio(num, trace << bits) for (num, bits), _ in found])
    axes = np.array([v for _, v in found]).T
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([_ratio(s % n, n) for s in sums])
    k = len(found)

    def white(y: np.ndarray) -> np.ndarray:
        """Projections of the centred rows; the whole part of the mean goes first, in integers."""
        return ((y - whole).astype(float) - part) @ axes / over

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = white(_entries(b.column("vector"), dims))
            total += w.sum(axis=0)
            products += w.T @ w
        values = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["i", "v"])

    flat = np.zeros(k + k * k)
    for r in rows.select("vector").mapInArrow(measure, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r["i"]] = r["v"]
    mean = flat[:k] / n
    error = float(np.abs(flat[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                y = _entries(b.column("vector"), dims)
                m, w = len(y), white(y)
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(row),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        deviations(y, n, sums).take(row),
                        pa.array(w.ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    [c.split()[0] for c in OUT.split(", ")],
                )

    return rows.mapInArrow(emit, OUT)


def deviations(y: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact ``sum((n * y - sums) ** 2)`` of every row; rows beyond 38 digits are null."""
    largest = n * int(np.abs(y).max(initial=0)) + max(abs(s) for s in sums)
    if largest * largest * y.shape[1] < 1 << 62:
        z = n * y - np.array(sums, np.int64)
        values = (z * z).sum(axis=1).tolist()
    else:
        z = n * y.astype(object) - np.array(sums, object)
        values = (z * z).sum(axis=1).tolist()
    return pa.array([Decimal(v) if v < 10**38 else None for v in values], pa.decimal128(38, 0))


def _ratio(a: int, b: int) -> float:
    """``a / b`` of integers of any size."""
    return a / b if b else 0.0
