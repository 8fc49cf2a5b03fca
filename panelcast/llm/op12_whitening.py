"""Whitening of vectors by the exact characteristic polynomial of their scatter matrix.

Components become x = floor(64 * c) + 1000000; the fit list holds every distinct vector
once.  Spark adds up sums and products of the fit list in whole numbers, which gives the
integer scatter A = n * sum(x x') - S S' = n^2 * V without rounding (a shift of x leaves A
alone, so x is taken without the million).

The characteristic polynomial of A follows modulo as many primes as its largest possible
coefficient asks for: for each prime, a task reduces A to Hessenberg form and takes the
polynomial by the recurrence on its leading blocks; the driver joins the residues by Chinese
remaindering.  All roots are real, so the sign changes of the polynomial shifted by a count
the roots beyond a exactly; halving intervals isolates them, with their multiplicity, and
goes on until an interval is one unit of a grid far finer than a double.  Components are
null vectors of A - root, by inverse iteration in decimals of the same precision; the m
vectors of an m-fold root are made orthogonal.

The driver holds d x d numbers and the polynomial, whatever the rows; rows meet the
components in tasks.  A vector that a third of the rows repeat is one row of the fit list.

Vectors that are null or hold null or non-finite entries are dropped; a shorter vector
counts as padded with zeros.  Null ids and repeated rows come back as they came.  A
component without variance cannot be whitened: there are at most as many components as the
rank, and none for an empty table or a single distinct vector.  A deviation beyond a long is
null; entries beyond a long are cut to its range.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.frames import tasks
from panelcast.llm.op1_voronoi import matrix
from panelcast.session import stage

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
BITS = 256  # of a root
DIGITS = 120  # of the decimals in which components are found: more than a root's own
CHUNK = 1 << 12  # rows multiplied at a time
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_rows(table: DataFrame, ids: str, vectors: str) -> tuple[DataFrame, int]:
    """(vec_id, v) without the shift, all of the same width, written once; and the width."""
    x = F.col(vectors).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = table.filter(F.col(vectors).isNotNull() & ~bad)
    width = kept.agg(F.max(F.size(vectors))).first()[0] or 0
    whole = F.transform(x, lambda c: F.floor(SCALE * c).cast("long"))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vectors)))
    return stage(kept.select(F.col(ids).cast("long").alias("vec_id"), padded.alias("v")), "whole-vectors"), width


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([str(v) for v in values])


def products(x: np.ndarray, largest: int) -> np.ndarray:
    """x' x in whole numbers: float64 where the sums stay exact, else Python's integers."""
    if len(x) * largest * largest < 1 << 53:
        y = x.astype(float)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums, and sums of products of the fit list."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            x = matrix(batch.column(0), width)
            for a in range(0, len(x), CHUNK):
                part = x[a : a + CHUNK]
                largest = max(int(part.max()), -int(part.min()))
                squares += products(part, largest)
                sums += part.astype(object).sum(0) if largest * len(part) >= 1 << 62 else part.sum(0).astype(object)
                n += len(part)
        values = [n, *sums, *squares[np.triu_indices(width)]]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), _decimals(values)], names=["cell", "value"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, int] = {}
        for batch in batches:
            for cell, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out[cell] = out.get(cell, 0) + int(value)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), _decimals(list(out.values()))], names=["cell", "value"])

    schema = "cell long, value string"
    partial = fit.select("v").mapInArrow(add, schema)
    # one row per cell: 1 + d + d * (d + 1) / 2
    rows = partial.repartition(tasks(fit), "cell").mapInArrow(total, schema).toArrow()
    size = 1 + width + width * (width + 1) // 2
    values = [0] * size
    for cell, value in zip(rows["cell"].to_pylist(), rows["value"].to_pylist()):
        values[cell] = int(value)
    squares = np.zeros((width, width), object)
    squares[np.triu_indices(width)] = values[1 + width :]
    squares = np.where(np.triu(np.ones((width, width), bool)), squares, squares.T)
    return values[0], values[1 : 1 + width], squares


def primes(count: int) -> list[int]:
    """The largest primes below 2^31, whose products of two residues fit a long."""
    sieve = np.ones(46342, bool)
    sieve[:2] = False
    for i in range(2, 216):
        if sieve[i]:
            sieve[i * i :: i] = False
    small = np.flatnonzero(sieve)
    out, at = [], (1 << 31) - 1
    while len(out) < count:
        if (at % small != 0).all():
            out.append(at)
        at -= 2
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo ``p`` that is zero below the first subdiagonal."""
    h = a.copy()
    for m in range(1, len(h) - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(1)) % p
    return h


def residues(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of the characteristic polynomial modulo ``p``, constant first."""
    h, d = hessenberg(a, p), len(a)
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - h[k - 1, k - 1] * poly[k - 1]) % p
        product = 1
        for i in range(1, k):
            product = product * int(h[k - i, k - i - 1]) % p
            if not product:
                break
            poly[k] = (poly[k] - product * int(h[k - i - 1, k - 1]) % p * poly[k - i - 1]) % p
    return poly[d]


def characteristic(spark: SparkSession, a: np.ndarray) -> list[int]:
    """The characteristic polynomial of a positive semidefinite integer matrix, constant first."""
    d = len(a)
    mean = -(-int(np.trace(a)) // d)
    # elementary symmetric functions of d roots that are not negative are largest where all are equal
    bound = max(math.comb(d, k) * mean**k for k in range(d + 1))
    moduli = primes(-(-(2 * bound + 1).bit_length() // 30))
    rows = a.tolist()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = residues(np.array([[v % p for v in r] for r in rows], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, p)), pa.array(np.arange(d + 1)), pa.array(found)], names=["p", "power", "residue"])

    spread = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(min(len(moduli), 4 * spark.sparkContext.defaultParallelism))
    known = spread.mapInArrow(task, "p long, power long, residue long").toArrow()
    whole = math.prod(moduli)
    weight = {p: whole // p * pow(whole // p, -1, p) for p in moduli}
    out = [0] * (d + 1)
    for p, power, residue in zip(*(known[c].to_pylist() for c in ("p", "power", "residue"))):
        out[power] += residue * weight[p]
    return [c - whole if c > whole // 2 else c for c in (v % whole for v in out)]


def shifted(poly: list[int], by: int) -> list[int]:
    """Coefficients of p(x + by)."""
    out = list(poly)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += by * out[j + 1]
    return out


def roots_beyond(poly: list[int], at: int) -> int:
    """How many roots are larger than ``at``; exact, as every root is real (Descartes)."""
    signs = [c > 0 for c in shifted(poly, at) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_at(poly: list[int], at: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * at + c
    return out


def largest_roots(poly: list[int], bound: int, count: int) -> tuple[list[tuple[Decimal, int]], int]:
    """(root, multiplicity), falling, until they are ``count`` or none but zero is left; none exceeds ``bound``.

    Roots are taken on a grid of 2^-extra, so fine that the largest has ``BITS`` bits.
    """
    extra = max(8, BITS - bound.bit_length())
    d = len(poly) - 1
    scaled = [c << (extra * (d - k)) for k, c in enumerate(poly)]
    top = (bound + 1) << extra
    out, found = [], 0
    # intervals (low, high] with the numbers of roots beyond either end, the highest last
    open_intervals = [(0, top, roots_beyond(poly, 0), 0)]
    while open_intervals and found < count:
        low, high, beyond_low, beyond_high = open_intervals.pop()
        inside = beyond_low - beyond_high
        if not inside:
            continue
        if inside == 1 or high - low == 1:
            if inside == 1 and high - low > 1:
                # one root, where the sign changes; it may be the upper end itself
                end = value_at(scaled, high)
                while high - low > 1 and end:
                    middle = (low + high) // 2
                    here = value_at(scaled, middle)
                    if here == 0:
                        low, high, end = middle - 1, middle, 0
                    elif (here > 0) == (end > 0):
                        high = middle
                    else:
                        low = middle
            with decimal.localcontext() as context:
                context.prec = DIGITS
                out.append((Decimal(high) / (1 << extra), inside))
            found += inside
            continue
        middle = (low + high) // 2
        beyond = roots_beyond(scaled, middle)
        open_intervals += [(low, middle, beyond_low, beyond), (middle, high, beyond, beyond_high)]
    return out, found


def null_vectors(a: np.ndarray, root: Decimal, count: int) -> list[np.ndarray]:
    """``count`` orthogonal unit vectors that A - root takes to nothing: inverse iteration in decimals."""
    with decimal.localcontext() as context:
        context.prec = DIGITS
        d = len(a)
        m = np.array([[Decimal(int(v)) for v in row] for row in a], object)
        m[np.arange(d), np.arange(d)] -= root
        tiny = (max(abs(v) for v in m.ravel()) or Decimal(1)) * Decimal(10) ** (-DIGITS + 10)
        turns = []
        for k in range(d):
            i = k + max(range(d - k), key=lambda j: abs(m[k + j, k]))
            turns.append(i)
            if i != k:
                m[[i, k]] = m[[k, i]]
            if abs(m[k, k]) < tiny:
                m[k, k] = tiny
            if k + 1 < d:
                m[k + 1 :, k] = m[k + 1 :, k] / m[k, k]
                m[k + 1 :, k + 1 :] = m[k + 1 :, k + 1 :] - np.outer(m[k + 1 :, k], m[k, k + 1 :])
        out: list[np.ndarray] = []
        for number in range(count):
            v = np.array([Decimal((7919 * (i + 1) * (number + 1) + 104729 * i * i) % 2003 - 1001) for i in range(d)], object)
            for _ in range(3):
                for k, i in enumerate(turns):
                    if i != k:
                        v[[i, k]] = v[[k, i]]
                for k in range(d):
                    v[k + 1 :] = v[k + 1 :] - m[k + 1 :, k] * v[k]
                for k in reversed(range(d)):
                    v[k] = (v[k] - (m[k, k + 1 :] @ v[k + 1 :] if k + 1 < d else Decimal(0))) / m[k, k]
                for other in out:
                    v = v - other * (other @ v)
                v = v / (v @ v).sqrt()
            out.append(v)
        return out


def components_of(spark: SparkSession, n: int, scatter: np.ndarray, count: int) -> list[tuple[np.ndarray, Decimal]]:
    """(unit vector, eigenvalue of the scatter) of the largest eigenvalues above zero."""
    bound = int(np.trace(scatter)) if len(scatter) else 0
    if n < 2 or not bound:
        return []
    poly = characteristic(spark, scatter)
    roots, _ = largest_roots(poly, bound, count)
    out = []
    for root, times in roots:
        out += [(v, root) for v in null_vectors(scatter, root, times)]
    return out[:count]


def scaled_rows(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """n * x - S as doubles, and the exact sum of its squares (None beyond a long)."""
    largest = max((max(int(x.max()), -int(x.min())) if x.size else 0) * n, max((abs(int(s)) for s in sums), default=0))
    kind = np.int64 if 4 * x.shape[1] * largest * largest < 1 << 62 else object
    y = x.astype(kind) * n - sums.astype(kind)
    far = (y * y).sum(1)
    return y.astype(float), [int(v) if int(v) < 1 << 63 else None for v in far]


def whiten(table: DataFrame, components: int = COMPONENTS, ids: str = "vec_id", vectors: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per kept row and component."""
    spark = table.sparkSession
    rows, width = whole_rows(table, ids, vectors)
    fit = stage(rows.select("v").distinct(), "fit-list")
    n, totals, squares = moments(fit, width) if width else (0, [], np.zeros((0, 0), object))
    sums = np.array(totals, object)
    scatter = n * squares - np.outer(sums, sums)
    chosen = components_of(spark, n, scatter, components)
    if not chosen:
        return spark.createDataFrame([], RESULT)
    with decimal.localcontext() as context:
        context.prec = DIGITS
        # (n x - S) / n on the component, over the root of e = eigenvalue / n^2
        basis = np.array([[float(c / root.sqrt()) for c in v] for v, root in chosen]).T
        trace = Decimal(int(np.trace(scatter)))
        explained = np.array([float(root / trace) for _, root in chosen])
    k = len(chosen)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = scaled_rows(matrix(batch.column(0), width), n, sums)[0] @ basis
            total += np.r_[w.sum(0), (w.T @ w).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])

    # k + k^2 rows
    found = fit.select("v").mapInArrow(spread, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(k + k * k)
    total[found["cell"].to_numpy()] = found["value"].to_numpy()
    mean = total[:k] / n
    error = float(np.abs(total[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, far = scaled_rows(matrix(batch.column(1), width), n, sums)
            m = len(far)
            every = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(far, pa.int64()).take(every), pa.array((y @ basis).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(task, RESULT)
