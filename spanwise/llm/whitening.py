"""Operator 13, embedding whitening: principal components by FEAST contour integration.

Entries are fixed-point numbers x = floor(256 c).  The fit list holds each distinct x vector once;
Spark reduces it to its size n, its exact sums S, and the covariance of the centred vectors (divisor n),
a matrix of dimension x dimension, whatever the number of rows.

FEAST projects a random block onto the eigenvectors of an interval: the resolvent (zI - V)^-1 is
integrated along a circle around the interval by Gauss quadrature, one complex shifted solve per
node; Rayleigh-Ritz in the projected block gives the eigenpairs, and the step repeats from these until
their residuals are at rounding level.  How many eigenvalues an interval holds is known beforehand from
inertia counts (signs of the pivots of V - sigma I, taken on its tridiagonal form), so a missed one is
noticed and the block made wider.

Defined results: rows with a null vector, or a null, NaN or infinite entry, or an entry whose x is no
64-bit integer, are dropped, and so are vectors of another length than most distinct ones have (ties: the
longer).  Repeated rows and ids each give rows of their own.  Where the covariance has fewer positive
eigenvalues than components are asked for, the others have ``explained`` 0 and a null ``whitened``; a
``deviation`` that exceeds 64 bits is null.  An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.common import Tables

SCALE = 256
COMPONENTS = 4
NODES = 8  # quadrature points on the upper half of the circle
STEPS = 60
SLACK = 6  # an interval may hold so many eigenvalues more than asked for
ROWS = 4096  # vectors multiplied at a time inside a task
_LONG = 1 << 63


# ---- eigenvectors of a symmetric matrix ------------------------------------------------------------

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = np.array(v, dtype=np.float64)
    d = len(a)
    off = np.zeros(max(d - 1, 0))
    for k in range(d - 1):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        off[k] = length
        if length == 0:
            continue
        off[k] = -np.copysign(length, x[0])
        x[0] -= off[k]
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        w = p - x * (x @ p)
        rest -= 2.0 * (np.outer(x, w) + np.outer(w, x))
    return np.diagonal(a).copy(), off


def count_above(diagonal: np.ndarray, off: np.ndarray, sigma: float) -> int:
    """Eigenvalues above ``sigma``: positive pivots of the factorised, shifted matrix (its inertia)."""
    least = np.finfo(float).tiny * max(1.0, float(np.max(np.abs(off), initial=0.0)) ** 2)
    above, pivot = 0, 1.0
    for k, x in enumerate(diagonal):
        pivot = x - sigma - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < least:
            pivot = -least
        above += pivot > 0
    return above


def feast(v: np.ndarray, low: float, high: float, expected: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """All ``expected`` eigenpairs of symmetric ``v`` with eigenvalues in (low, high), falling."""
    d = len(v)
    centre, radius = (low + high) / 2.0, (high - low) / 2.0
    at, weight = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * np.pi / 2.0 * (1.0 - at))
    size = float(np.linalg.norm(v, 2))
    for width in (min(d, expected + SLACK + 2), min(d, 3 * expected + 2 * SLACK), d):
        block = np.random.default_rng(width).standard_normal((d, width))
        best, before = None, np.inf
        for _ in range(STEPS):
            moved = np.zeros((d, width))
            for t, w in zip(turn, weight, strict=True):
                solved = np.linalg.solve((centre + radius * t) * np.eye(d) - v, block.astype(complex))
                moved += w / 2.0 * (radius * t * solved).real
            basis, _ = np.linalg.qr(moved)
            ritz, small = np.linalg.eigh(basis.T @ v @ basis)  # Rayleigh-Ritz
            block = basis @ small
            inside = np.flatnonzero((ritz > low) & (ritz < high))[::-1]
            if len(inside) != expected:
                continue
            residual = float(np.max(np.linalg.norm(v @ block[:, inside] - block[:, inside] * ritz[inside], axis=0)))
            if residual < before:
                best = ritz[inside], block[:, inside]
            if residual <= 1e-15 * size or (residual <= 1e-12 * size and residual >= before / 2):
                return best
            before = min(before, residual)
    raise ArithmeticError("the interval's eigenvalues were not all found")


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues that are positive beyond rounding, falling, and unit eigenvectors (columns)."""
    d, trace = len(v), float(np.trace(v))
    if not d or trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    unit = v / trace  # eigenvalues in [0, 1]
    diagonal, off = tridiagonal(unit)
    noise = 8 * d * np.finfo(float).eps
    k = min(k, count_above(diagonal, off, noise))
    low, high, top = noise, 1.0, 1.0 + 1e-6
    # a cut that leaves k to k + SLACK eigenvalues above it, between two that are apart
    cuts = [noise] if count_above(diagonal, off, noise) <= k + SLACK else []
    for _ in range(60):
        middle = (low * high) ** 0.5
        n = count_above(diagonal, off, middle)
        if k <= n <= k + SLACK:
            cuts.append(middle)
        if n >= k:
            low = middle
        else:
            high = middle
        if high / low < 1 + 1e-7:
            break
    cut = min(cuts, key=lambda s: (count_above(diagonal, off, s * (1 - 1e-3)) - count_above(diagonal, off, s * (1 + 1e-3)), s), default=low)
    values, vectors = feast(unit, cut, top, count_above(diagonal, off, cut))
    vectors = vectors[:, :k] * np.where(np.take_along_axis(vectors[:, :k], np.argmax(np.abs(vectors[:, :k]), axis=0)[None], 0) < 0, -1.0, 1.0)
    return values[:k] * trace, vectors


# ---- Spark side ------------------------------------------------------------------------------------

def fixed_point(vectors: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose entries are all numbers; the casts keep doubles."""
    c = F.col(f"`{vector_col}`").cast("array<double>")
    usable = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(_LONG // SCALE))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & F.forall("c", usable))
    return rows.select("vec_id", F.transform("c", lambda e: F.floor(e * F.lit(float(SCALE))).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _matrices(batches, d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.column("x").slice(start, ROWS), d)


def _summed(fit: DataFrame, d: int, make: Callable[[np.ndarray], np.ndarray], rows: int, width: int) -> np.ndarray:
    """Sum over all vectors of ``make(matrix)`` (rows x width): one partial sum a task, added up by row."""

    def part(batches):
        total = np.zeros((rows, width))
        for x in _matrices(batches, d):
            total += make(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
                found[i] = found.get(i, 0.0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([r.tobytes() for r in found.values()], pa.binary())], ["i", "row"])

    out = np.zeros((rows, width))
    for r in fit.mapInArrow(part, "i int, row binary").repartition("i").mapInArrow(add, "i int, row binary").collect():
        out[r["i"]] = np.frombuffer(r["row"])
    return out


def exact_sums(fit: DataFrame, d: int) -> list[int]:
    """Per-dimension sums of the fit list, as integers of any size."""

    def part(batches):
        total = [0] * d
        for x in _matrices(batches, d):
            safe = int(np.abs(x).max()) < _LONG // (ROWS + 1)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0) if safe else x.astype(object).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    rows = fit.mapInArrow(part, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(s) for _, s in sorted((r["i"], r["s"]) for r in rows)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per vector the sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if len(sums) * most * most < _LONG:
        return [int(t) for t in ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1)]
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(t) if t < _LONG else None for t in exact]


def whitened(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    spark = vectors.sparkSession
    base = fixed_point(vectors, vector_col, id_col)
    schema = T.StructType([base.schema["vec_id"], *[T.StructField(c, t()) for c, t in (
        ("component", T.IntegerType), ("n", T.LongType), ("deviation", T.LongType), ("whitened", T.DoubleType),
        ("explained", T.DoubleType), ("identity_error", T.DoubleType))]])
    distinct = Tables(spark, "whitening").store(base.select("x").distinct(), "fit")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None or not sizes["d"]:
        return spark.createDataFrame([], schema)
    d, n = sizes["d"], sizes["n"]
    fit = distinct.where(F.size("x") == d)
    sums = exact_sums(fit, d)
    mean = np.array([float(Decimal(s) / n) for s in sums])
    centred = lambda x: x - mean
    v = _summed(fit, d, lambda x: centred(x).T @ centred(x), d, d) / n
    v = (v + v.T) / 2.0
    values, vecs = leading(v, min(components, d))
    project = vecs / np.sqrt(values)
    k, found = min(components, d), len(values)
    error = None
    if found:
        shift = _summed(fit, d, lambda x: (centred(x) @ project).sum(axis=0)[None], 1, found)[0] / n
        spread = _summed(fit, d, lambda x: (y := centred(x) @ project - shift).T @ y, found, found) / n
        error = float(np.max(np.abs(spread - np.eye(found))))
    trace = float(np.trace(v))
    explained = [float(e) / trace for e in values] + [0.0] * (k - found)

    def score(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = _matrix(part.column("x"), d)
                w = np.full((len(x), k), np.nan)
                w[:, :found] = centred(x) @ project
                rows = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n), pa.int64()),
                    pa.array([t for t in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                    pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())),
                    pa.array(np.tile(explained, rows), pa.float64()),
                    pa.array([error] * (rows * k), pa.float64()),
                ], schema.names)

    return base.where(F.size("x") == d).mapInArrow(score, schema)
