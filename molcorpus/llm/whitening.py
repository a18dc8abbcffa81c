"""Embedding whitening from the exact characteristic polynomial of an integer scatter matrix.

Every entry ``c`` becomes the integer ``floor(64 c) + 1000000``. One pass sums the vectors, a second
one the products of what is left after subtracting the rounded mean (any whole number leaves the
scatter as it is, and small numbers keep the sums exact): ``scatter = n * sum(y y') - s s'`` is
``n * n`` times the covariance, without rounding. Its characteristic polynomial is worked out
modulo many primes, one task a few primes, by reduction to Hessenberg form; Chinese remaindering
puts the integer coefficients together. All roots are real, so that the sign changes of the
polynomial shifted by ``a`` are exactly the roots above ``a``, each as often as it is one
(Descartes): bisection isolates them, and goes on by the sign alone to ``BITS`` bits. Components
come from the null space of ``scatter - root``: elimination and inverse iteration in decimal
numbers of ``DIGITS`` digits, roots that agree together, one task a few components.

What reaches the driver is bounded by the number of dimensions: sums, products, coefficients,
components. Rows whose vector is null or holds null or non-finite entries are left out, as are
vectors of another length than most (ties: the shorter one) and empty ones; rows that repeat
or have no id are rows like others. Directions without spread have no component: copies of one
vector, a single row and an empty table give an empty result. Columns of other names are ignored.
Entries beyond 2**45 and a deviation beyond 64 bits are errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**45
COMPONENTS = 32
# Bits to which a root is known beyond its leading one, digits of decimal work.
BITS, DIGITS = 140, 90
# Rows of a batch whose products are summed at once.
ROWS = 1024


def finite(vector: Column) -> Column:
    inner = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(inner, F.lit(False))


def quantised(column: pa.Array, dims: int) -> np.ndarray:
    """Whole numbers, without the shift, of an Arrow column of vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    if flat.size and np.abs(flat).max() > LARGEST:
        raise ValueError("an entry is beyond 2**45")
    return np.floor(flat * SCALE).astype(np.int64)


# --- The exact scatter ------------------------------------------------------------


def exact_products(y: np.ndarray) -> list[int]:
    """The upper triangle of ``y' y`` of up to ``ROWS`` rows, without rounding or overflow."""
    upper = np.triu_indices(y.shape[1])
    if float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2.0**53:
        double = y.astype(np.float64)
        return [int(x) for x in (double.T @ double)[upper].tolist()]
    # halves of 26 bits: their products sum up in 64 bits
    low, high = y & ((1 << 26) - 1), y >> 26
    ends = (low.T @ low)[upper].tolist(), (high.T @ high)[upper].tolist()
    mixed = low.T @ high
    mixed = mixed[upper].tolist(), mixed.T[upper].tolist()
    return [a + ((c + d) << 26) + (b << 52) for a, b, c, d in zip(*ends, *mixed)]


def whole(column: str, name: str) -> Column:
    return F.sum(F.col(column).cast("decimal(38,0)")).alias(name)


def totals(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension (without the shift)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = quantised(batch.column("v"), dims)
            n += len(x)
            # the high and the low half apart, which sum up without overflow
            low, high = (x & 0xFFFFFF).sum(0).tolist(), (x >> 24).sum(0).tolist()
            total = [t + a + (b << 24) for t, a, b in zip(total, low, high)]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array([-1, *range(dims)], pa.int32()), "s": [str(n), *map(str, total)]})

    got = rows.select("v").mapInArrow(add, "i int, s string").groupBy("i").agg(whole("s", "s")).collect()
    found = {r["i"]: int(r["s"]) for r in got}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


def scatter(rows: DataFrame, dims: int, n: int, total: list[int]) -> list[list[int]]:
    """``n * n`` times the covariance, exactly."""
    mean = np.array([s // n for s in total], np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = [0] * (dims * (dims + 1) // 2)
        seen = False
        for batch in batches:
            x = quantised(batch.column("v"), dims) - mean
            for start in range(0, len(x), ROWS):
                seen = True
                upper = [a + b for a, b in zip(upper, exact_products(x[start : start + ROWS]))]
        if seen:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(upper)), pa.int32()), "s": list(map(str, upper))})

    got = rows.select("v").mapInArrow(add, "i int, s string").groupBy("i").agg(whole("s", "s")).collect()
    found = {r["i"]: int(r["s"]) for r in got}
    rest = [s - n * int(m) for s, m in zip(total, mean)]
    out = [[0] * dims for _ in range(dims)]
    for at, (i, j) in enumerate(zip(*(side.tolist() for side in np.triu_indices(dims)))):
        out[i][j] = out[j][i] = n * found[at] - rest[i] * rest[j]
    return out


# --- The characteristic polynomial ---------------------------------------------------


def is_prime(n: int) -> bool:
    """Exact below 3.4e12 for these bases."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13)):
        return n in (2, 3, 5, 7, 11, 13)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2**31 whose product has more than so many bits."""
    found, got, p = [], 0.0, (1 << 31) - 1
    while got <= bits:
        if is_prime(p):
            found.append(p)
            got += 30.999
        p -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, from the constant one, of ``det(x - matrix)`` modulo a prime below 2**31."""
    h = matrix % p
    d = len(h)
    for k in range(d - 2):
        there = np.flatnonzero(h[k + 1 :, k])
        if not len(there):
            continue
        pivot = k + 1 + int(there[0])
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        ratio = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - ratio[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * ratio % p).sum(1)) % p
    found = np.zeros((d + 1, d + 1), np.int64)
    found[0, 0] = 1
    for k in range(1, d + 1):
        found[k, 1:] = found[k - 1, :-1]
        weights = np.zeros(k, np.int64)
        below = 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        found[k] = (found[k] - (weights[:, None] * found[:k] % p).sum(0)) % p
    return found[d]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The integer coefficients of ``det(x - matrix)`` of a symmetric matrix without negative
    eigenvalues, from the constant one. Each is at most ``(1 + trace / d) ** d``."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # the sum of all products of k eigenvalues is largest where all are equal
    chosen = primes(d * ((trace // d + 2).bit_length()) + 2)
    flat = [str(x) for row in matrix for x in row]
    shared = spark.sparkContext.broadcast(flat)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [int(x) for x in shared.value]
        for batch in batches:
            for p in batch.column("p").to_pylist():
                found = polynomial_modulo(np.array([x % p for x in values], np.int64).reshape(d, d), p)
                yield pa.RecordBatch.from_pydict({"p": [p], "c": pa.array([found.tolist()], pa.list_(pa.int64()))})

    tasks = max(1, min(len(chosen), 2 * spark.sparkContext.defaultParallelism))
    wanted = spark.createDataFrame(pa.table({"p": pa.array(chosen, pa.int64())})).repartition(tasks)
    rows = wanted.mapInArrow(reduce, "p bigint, c array<bigint>").collect()
    # the residues of all primes, put together by halves
    parts = [(r["p"], r["c"]) for r in rows]
    while len(parts) > 1:
        paired = [joined(*parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
        parts = paired + parts[len(parts) // 2 * 2 :]
    whole, found = parts[0]
    return [c - whole if 2 * c > whole else c for c in found]


def joined(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    """Residues modulo the product of two moduli without a common factor."""
    (p, x), (q, y) = a, b
    inverse = pow(p, -1, q)
    return p * q, [u + p * ((v - u) * inverse % q) for u, v in zip(x, y)]


# --- Its roots ----------------------------------------------------------------------


def shifted(c: list[int], a: int) -> list[int]:
    """The coefficients of ``c(x + a)``."""
    out = list(c)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += a * out[j + 1]
    return out


def above(c: list[int], a: int) -> int:
    """How many roots are above ``a``, if all are real."""
    signs = [x > 0 for x in shifted(c, a) if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign(c: list[int], a: int) -> int:
    value = 0
    for x in reversed(c):
        value = value * a + x
    return (value > 0) - (value < 0)


def roots(c: list[int], most: int) -> list[tuple[int, int]]:
    """The largest positive roots, falling: (number, how many). A root is the number over ``2**s``
    with ``s = scale(c)``, rounded up; roots with the same number are one entry."""
    s = scale(c)
    d = len(c) - 1
    c = [x << (s * (d - i)) for i, x in enumerate(c)]
    high = 1 << (-c[-2]).bit_length()  # no root is above the sum of all
    found: list[tuple[int, int]] = []
    work = [(0, high, above(c, 0), 0)]
    while work and sum(n for _, n in found) < most:
        low, high, n, m = work.pop()  # n roots above low, m above high
        if n == m:
            continue
        if high - low == 1:
            found.append((high, n - m))
        elif n - m == 1:
            # one root: above it the polynomial has the sign of its parity
            up = -1 if m % 2 else 1
            while high - low > 1:
                mid = (low + high) // 2
                at = sign(c, mid)
                low, high = (low, mid) if at in (up, 0) else (mid, high)
            found.append((high, 1))
        else:
            mid = (low + high) // 2
            between = above(c, mid)
            work += [(low, mid, n, between), (mid, high, between, m)]
    return found


def scale(c: list[int]) -> int:
    """Fractional bits, so that the largest root has ``BITS`` bits at least."""
    return max(0, BITS - (-c[-2]).bit_length()) if len(c) > 1 and c[-2] else BITS


# --- Components -----------------------------------------------------------------------


def null_space(matrix: list[list[int]], root: int, bits: int, size: int) -> list[list[float]]:
    """Orthonormal vectors of an eigenvalue ``root / 2**bits`` that is there ``size`` times."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        value = Decimal(root) / Decimal(1 << bits)
        least = value.scaleb(10 - DIGITS)
        a = np.array([[Decimal(x) for x in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= value
        rows, columns = np.arange(d), np.arange(d)
        for k in range(d):
            # the largest entry of what is left, so that the null space comes last
            i, j = divmod(int(np.argmax(np.abs(a[k:, k:]).astype(np.float64))), d - k)
            a[[k, k + i]], rows[[k, k + i]] = a[[k + i, k]], rows[[k + i, k]]
            a[:, [k, k + j]], columns[[k, k + j]] = a[:, [k + j, k]], columns[[k + j, k]]
            if abs(a[k, k]) < least:
                a[k, k] = least
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])
        draw = np.random.default_rng(size)
        vectors = [np.array([Decimal(int(x)) for x in draw.integers(-999, 1000, d)], object) for _ in range(size)]
        for _ in range(2):
            solved = []
            for v in vectors:
                x = v[rows]
                for k in range(1, d):
                    x[k] = x[k] - (a[k, :k] * x[:k]).sum()
                for k in range(d - 1, -1, -1):
                    x[k] = (x[k] - (a[k, k + 1 :] * x[k + 1 :]).sum()) / a[k, k]
                v = np.empty(d, object)
                v[columns] = x
                solved.append(v)
            vectors = orthonormal(solved)
        return [[float(x) for x in v] for v in vectors]


def orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
    done: list[np.ndarray] = []
    for v in vectors:
        for _ in range(2):
            for u in done:
                v = v - u * (u * v).sum()
            v = v / (v * v).sum().sqrt()
        done.append(v)
    return done


def components(
    spark: SparkSession, matrix: list[list[int]], most: int = COMPONENTS
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Unit components as rows, by falling eigenvalue, and their eigenvalues as fractions."""
    if not any(map(any, matrix)):
        return np.empty((0, len(matrix))), []
    c = polynomial(spark, matrix)
    found, bits, d = roots(c, most), scale(c), len(matrix)
    flat = [str(x) for row in matrix for x in row]
    shared = spark.sparkContext.broadcast(flat)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [int(x) for x in shared.value]
        own = [values[i : i + d] for i in range(0, d * d, d)]
        for batch in batches:
            for i, root, size in zip(*(batch.column(k).to_pylist() for k in ("i", "root", "size"))):
                vectors = [v if max(v, key=abs) > 0 else [-x for x in v] for v in null_space(own, int(root), bits, size)]
                yield pa.RecordBatch.from_pydict(
                    {"i": pa.array([i] * size, pa.int32()), "v": pa.array(vectors, pa.list_(pa.float64()))}
                )

    asked = pa.table({
        "i": pa.array(range(len(found)), pa.int32()),
        "root": [str(r) for r, _ in found],
        "size": pa.array([n for _, n in found], pa.int32()),
    })
    tasks = max(1, min(len(found), 2 * spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame(asked).repartition(tasks).mapInArrow(solve, "i int, v array<double>").collect()
    rows.sort(key=lambda r: r["i"])
    values = [(root, 1 << bits) for root, n in found for _ in range(n)]
    return np.array([r["v"] for r in rows])[:most], values[:most]


# --- Whitening -------------------------------------------------------------------------


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS
) -> DataFrame:
    """One row per vector and component: key, component from 1, n, deviation, whitened,
    explained, identity_error."""
    spark = vectors.sparkSession
    kept = vectors.filter(F.col(vector).isNotNull() & finite(F.col(vector)) & (F.size(vector) > 0))
    common = kept.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    id_type = vectors.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double,"
        " identity_error double"
    )
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["n"]
    rows = kept.filter(F.size(vector) == dims).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    n, total = totals(rows, dims)
    matrix = scatter(rows, dims, n, total)
    axes, values = components(spark, matrix, most)
    if not len(axes):
        return spark.createDataFrame([], schema)
    trace = sum(matrix[i][i] for i in range(dims))
    # eigenvalues of the covariance: the scatter's over n * n
    deviations = np.array([(a / (b * n * n)) ** 0.5 for a, b in values])
    explained = np.array([a / (b * trace) for a, b in values])
    mean = np.array([s // n for s in total], np.int64)
    rest = np.array([s % n for s in total], np.int64)
    k = len(axes)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        """``n * x - S``, exactly."""
        x = quantised(batch.column("v"), dims) - mean
        if np.abs(x).max(initial=0) * 1.0 * n > 2.0**62:
            raise ValueError("a deviation is beyond 64 bits")
        return x * n - rest

    def scores(whole: np.ndarray) -> np.ndarray:
        return (whole / n) @ axes.T / deviations

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(k)
        for batch in batches:
            found += scores(centred(batch)).sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k), pa.int32()), "s": found})

    means = sorted(rows.select("v").mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect())
    centre = np.array([r["s"] for r in means]) / n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((k, k))
        for batch in batches:
            w = scores(centred(batch)) - centre
            found += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k * k), pa.int32()), "s": found.ravel()})

    got = rows.select("v").mapInArrow(products, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    covariance = np.array([r["s"] for r in sorted(got)]).reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())

    def deviation(whole: np.ndarray) -> np.ndarray:
        if (whole.astype(np.float64) ** 2).sum(1).max(initial=0) < 2.0**62:
            return (whole * whole).sum(1)
        exact = (whole.astype(object) ** 2).sum(1)
        if max(exact) >= 1 << 63:
            raise ValueError("a deviation is beyond 64 bits")
        return exact.astype(np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                whole = centred(part)
                rows = part.num_rows
                repeated = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k").take(pa.array(repeated)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, n, np.int64)),
                        pa.array(deviation(whole)[repeated]),
                        pa.array(scores(whole).ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * k, error)),
                    ],
                    names,
                )

    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.mapInArrow(project, schema)

