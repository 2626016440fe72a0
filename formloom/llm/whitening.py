"""Whitening of embeddings from an exact characteristic polynomial.

Entries become integers, so their scatter matrix is summed without rounding.  Its
characteristic polynomial is found modulo many primes, each by reduction to
Hessenberg form, and put together by Chinese remaindering: the coefficients are exact.
The matrix is symmetric, so all roots are real, and the number of roots above a point
is the number of sign changes in the polynomial shifted there (Descartes' rule, exact
for such polynomials, multiple roots included).  That isolates the largest roots,
however close; inverse iteration in high precision on the nearly singular shifted
matrix then gives each component.

Spark sums the scatter over all rows, reduces the primes side by side and projects the
rows.  Only the d x d scatter and the polynomial meet on the driver, whose size is that
of a vector's square, whatever the number of rows.
"""

from __future__ import annotations

import decimal
import random
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.session import stage

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Scaled entries are held to this range, so that they stay exact 64-bit integers.
EDGE = 1 << 60
LIMB = 40
#: Roots are told apart to this share of the largest; nearer ones count as one root.
ROOT_BITS = 200
#: Decimal digits of the inverse iteration.
DIGITS = 120
#: Primes below 2^31, so that products of residues fit 64 bits.
PRIME_TOP = 1 << 31


# Rows to integers -----------------------------------------------------------------

def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _integers(column: pa.ListArray, d: int) -> np.ndarray:
    """floor(SCALE * c) of every entry: rows x d."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.clip(np.floor(flat * SCALE), -float(EDGE), float(EDGE))
    return scaled.astype(np.int64).reshape(len(column), d)


def _scatter_sums(d: int):
    """Each task's sums of entries and of products, in limbs of 40 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            y = _integers(batch.column(0), d)
            if not len(y):
                continue
            largest = int(np.abs(y).max())
            if largest * largest * len(y) < 1 << 53:  # exact in doubles, where products are fast
                part = (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
            elif largest * largest * len(y) < 1 << 62:
                part = y.T @ y
            else:
                wide = y.astype(object)
                part = wide.T @ wide
            products += part.astype(object)
            sums += (y.sum(axis=0) if largest * len(y) < 1 << 62 else y.astype(object).sum(axis=0)).astype(object)
        out = []
        for i in range(d):
            for j, value in [(-1, sums[i]), *((j, products[i, j]) for j in range(i, d))]:
                sign, rest, limb = (1 if value >= 0 else -1), abs(int(value)), 0
                while rest:
                    out.append((i, j, limb, sign * (rest & ((1 << LIMB) - 1))))
                    rest >>= LIMB
                    limb += 1
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["i", "j", "limb", "value"])

    return run


def scatter(vectors: DataFrame, vector: str, d: int) -> tuple[list[int], list[list[int]]]:
    """The exact sums of the integers' entries and of their products, by dimension."""
    parts = vectors.select(F.col(vector)).mapInArrow(_scatter_sums(d), "i int, j int, limb int, value bigint")
    told = parts.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect()  # some numbers for each entry of d x d
    sums, products = [0] * d, [[0] * d for _ in range(d)]
    for i, j, limb, value in told:
        if j < 0:
            sums[i] += value << (LIMB * limb)
        else:
            products[i][j] += value << (LIMB * limb)
    for i in range(d):
        for j in range(i):
            products[i][j] = products[j][i]
    return sums, products


# The characteristic polynomial ----------------------------------------------------

def _is_prime(n: int) -> bool:
    """Deterministic below 3.2e9 (strong probable primes to 2, 3, 5 and 7)."""
    if any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17, 19, 23)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
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
    """The largest primes below 2^31 whose product has more than ``bits`` bits."""
    found, product, n = [], 1, PRIME_TOP - 1
    while product.bit_length() <= bits:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo p, constant first, by Hessenberg form."""
    h = np.array([[v % p for v in row] for row in matrix], dtype=np.int64)
    d = len(h)
    for k in range(1, d - 1):  # clear column k - 1 below row k by similarity
        pivots = np.nonzero(h[k:, k - 1])[0]
        if not len(pivots):
            continue
        at = k + int(pivots[0])
        if at != k:
            h[[k, at]] = h[[at, k]]
            h[:, [k, at]] = h[:, [at, k]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k][None, :] % p) % p
        # Column k takes up u times the later columns, two numbers' product at a time.
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u[None, :] % p).sum(axis=1)) % p
    polys = [np.array([1], dtype=np.int64)]
    for k in range(d):
        new = np.zeros(k + 2, dtype=np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - polys[k] * int(h[k, k]) % p) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            factor = below * int(h[i, k]) % p
            new[: i + 1] = (new[: i + 1] - polys[i] * factor % p) % p
        polys.append(new % p)
    return [int(c) for c in polys[d]]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The exact coefficients of det(x I - matrix), constant first, for a symmetric
    matrix without negative eigenvalues: primes are reduced side by side, then joined."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # The sum of the coefficients' sizes is the product of (1 + root): at most (1 + trace / d)^d.
    bits = d * (trace // d + 2).bit_length() + 2
    moduli = primes(bits)
    if d < 3 or len(moduli) < 4:
        residues = {p: polynomial_mod(matrix, p) for p in moduli}
    else:
        def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [polynomial_mod(matrix, int(p)) for p in batch["p"]]
                yield pd.DataFrame({"p": batch["p"], "c": rows})

        tasks = min(len(moduli), max(1, spark.sparkContext.defaultParallelism))
        table = spark.createDataFrame([(p,) for p in moduli], "p bigint").repartition(tasks)
        residues = {r.p: list(r.c) for r in table.mapInPandas(reduce, "p bigint, c array<bigint>").collect()}
    modulus = 1
    for p in moduli:
        modulus *= p
    total = [0] * (d + 1)
    for p in moduli:
        others = modulus // p
        weight = others * pow(others % p, -1, p)
        for k, c in enumerate(residues[p]):
            total[k] += c * weight
    return [c - modulus if (c := t % modulus) * 2 > modulus else c for t in total]


# Its largest roots ----------------------------------------------------------------

def _scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    d = len(poly) - 1
    return [c << (bits * (d - k)) for k, c in enumerate(poly)]


def roots_above(poly: list[int], at: int) -> int:
    """How many roots, all being real, are greater than the integer ``at``."""
    shifted = list(poly)
    d = len(shifted) - 1
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += at * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], at: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * at + c
    return total


def largest_roots(poly: list[int], wanted: int, bits: int = ROOT_BITS) -> tuple[list[int], int]:
    """The ``wanted`` largest positive roots, falling, multiple ones repeated: integers
    ``r`` and the power ``s`` for which each root lies in (r, r + 1] / 2^s.

    Roots are isolated by counting; one that stands alone in its interval is then
    narrowed by the polynomial's sign alone.
    """
    top = sum(abs(c) for c in poly[-2:-1]) + 1  # the sum of the roots bounds each
    s = max(0, bits - top.bit_length())
    fine = _scaled(poly, s)
    high = top << s
    found: list[int] = []
    counts: dict[int, int] = {0: roots_above(fine, 0), high: 0}

    def above(at: int) -> int:
        if at not in counts:
            counts[at] = roots_above(fine, at)
        return counts[at]

    wanted = min(wanted, counts[0])
    while len(found) < wanted:
        nth = len(found) + 1
        lo = max(x for x, n in counts.items() if n >= nth)
        hi = min(x for x, n in counts.items() if n < nth)
        while hi - lo > 1 and above(lo) - above(hi) > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if above(mid) >= nth else (lo, mid)
        if hi - lo > 1:  # alone: the sign tells the side
            sign = _value(fine, hi) > 0
            if _value(fine, hi) == 0:
                lo = hi - 1
            while hi - lo > 1:
                mid = (lo + hi) // 2
                v = _value(fine, mid)
                if v == 0:
                    lo, hi = mid - 1, mid
                elif (v > 0) == sign:
                    hi = mid
                else:
                    lo = mid
            found.append(lo)
        else:
            found.extend([lo] * min(above(lo) - above(hi), wanted - len(found)))
            counts.setdefault(lo, len(found))
        counts[lo] = max(above(lo), len(found))
    return found, s


# Components -----------------------------------------------------------------------

def components(matrix: list[list[int]], roots: list[int], s: int) -> list[list[float]]:
    """A unit eigenvector for each root, by inverse iteration on the matrix shifted next
    to the root; vectors of equal roots are made orthogonal to one another."""
    d = len(matrix)
    dice = random.Random(7)
    made: list[tuple[int, list[Decimal]]] = []
    with decimal.localcontext() as context:
        context.prec = DIGITS
        context.Emin, context.Emax = decimal.MIN_EMIN, decimal.MAX_EMAX
        scale = Decimal(1 << s)
        for root in roots:
            # Just beside the interval (root, root + 1] / 2^s.
            shift = (Decimal(root) - Decimal("0.5")) / scale
            a = [[Decimal(v) - (shift if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
            order = list(range(d))
            for k in range(d):  # elimination with row exchange; factors stay below the diagonal
                at = max(range(k, d), key=lambda i: abs(a[i][k]))
                a[k], a[at] = a[at], a[k]
                order[k], order[at] = order[at], order[k]
                pivot = a[k][k] or Decimal(10) ** -DIGITS
                a[k][k] = pivot
                top = a[k]
                for i in range(k + 1, d):
                    row = a[i]
                    if row[k]:
                        f = row[k] / pivot
                        row[k] = f
                        for j in range(k + 1, d):
                            row[j] -= f * top[j]
            same = [v for r, v in made if r == root]
            vector = [Decimal(dice.randint(-1000, 1000)) for _ in range(d)]
            for _ in range(3):
                vector = _solve(a, order, vector)
                for other in same:
                    part = sum((x * y for x, y in zip(vector, other, strict=True)), Decimal(0))
                    vector = [x - part * y for x, y in zip(vector, other, strict=True)]
                length = sum((x * x for x in vector), Decimal(0)).sqrt()
                vector = [x / length for x in vector]
            made.append((root, vector))
    return [[float(x) for x in v] for _, v in made]


def _solve(a: list[list[Decimal]], order: list[int], b: list[Decimal]) -> list[Decimal]:
    d = len(a)
    x = [b[i] for i in order]
    for i in range(d):
        row = a[i]
        x[i] -= sum((row[j] * x[j] for j in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        row = a[i]
        x[i] = (x[i] - sum((row[j] * x[j] for j in range(i + 1, d)), Decimal(0))) / row[i]
    return x


# The operator ---------------------------------------------------------------------

OUT = "key bigint, deviation decimal(38,0), whitened array<double>"


def _project(d: int, n: int, sums: list[int], axes: np.ndarray):
    """Each row's exact deviation and its coordinates on the scaled components."""
    mean = [divmod(v, n) for v in sums]  # whole and rest, so that no digit of a sum is lost
    whole, rest = [w for w, _ in mean], np.array([r / n for _, r in mean])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _integers(batch.column(1), d)
            largest = max(int(np.abs(y).max()) if y.size else 0, 1) + max(map(abs, whole), default=0) + 1
            if (largest * n) ** 2 * d < 1 << 62:
                scaled = y * n - np.array(sums, dtype=np.int64)
                deviation = [int(v) for v in (scaled * scaled).sum(axis=1)]
            else:
                scaled = y.astype(object) * n - np.array(sums, dtype=object)
                deviation = [int(v) for v in (scaled * scaled).sum(axis=1)]
            centred = (y - np.array(whole, dtype=np.int64)).astype(np.float64) - rest
            coordinates = centred @ axes
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)),
                pa.array(list(coordinates), pa.list_(pa.float64())),
            ], names=["key", "deviation", "whitened"])

    return run


def whiten(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components_wanted: int = 8,
) -> DataFrame:
    """Every row's whitened coordinates: key, component, n, deviation, whitened,
    explained, identity_error.

    Rows whose vector is null or holds a null or a non-finite entry are left out, as are
    those of another length than the most common one (of equally common ones the
    longest).  Entries become the integers ``floor(1024 * c) + 100000`` (held to 2^60);
    ``n`` rows are left, ``deviation`` is the exact sum of ``(n * x - S)^2`` over the
    dimensions (null where that exceeds a bigint), ``component`` counts from 1 by falling
    variance, and components of no variance are left out.  ``identity_error`` is measured
    on the whitened rows.

    Null keys and repeated rows each count and give their rows; rows that are all equal,
    or an empty table, give an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector")).where(usable(F.col(vector)))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).first()  # the length of most rows
    schema = (
        f"`{key}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    if common is None or common.d == 0:
        return spark.createDataFrame([], schema)
    d, n = common.d, common.n
    rows = rows.where(F.size("vector") == d)
    sums, products = scatter(rows, "vector", d)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    poly = characteristic_polynomial(spark, matrix)
    roots, s = largest_roots(poly, components_wanted)
    if not roots:
        return spark.createDataFrame([], schema)
    axes = components(matrix, roots, s)
    trace = sum(matrix[i][i] for i in range(d))
    # The matrix is n^2 times the covariance, and so are its roots.
    variances = [(2 * r + 1) / (1 << (s + 1)) / n**2 for r in roots]
    scaled = np.array([[x / v**0.5 for x in axis] for axis, v in zip(axes, variances, strict=True)]).T
    made = stage(rows.select("key", "vector").mapInArrow(_project(d, n, sums, scaled), OUT), "whitened")

    c = len(roots)
    w = lambda i: F.get("whitened", F.lit(i))
    means = made.agg(*[F.avg(w(i)).alias(f"m{i}") for i in range(c)])
    centred = made.crossJoin(F.broadcast(means))  # one row
    error = F.greatest(*[
        F.abs(F.avg((w(i) - F.col(f"m{i}")) * (w(j) - F.col(f"m{j}"))) - float(i == j)) for i in range(c) for j in range(i + 1)
    ], F.lit(0.0))
    told = centred.agg(error.alias("identity_error"))
    explained = F.array(*[F.lit((2 * r + 1) / (trace << (s + 1))) for r in roots])
    return made.crossJoin(F.broadcast(told)).select(
        F.col("key").alias(key), F.posexplode("whitened").alias("at", "whitened"), "deviation", "identity_error",
    ).select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"),
        F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"),
        "identity_error",
    )
