"""Whitening of embeddings: leading components of the covariance by contour integration (FEAST).

The sums and the covariance are partial results of every task that merge by addition; only the matrix, whose
size is the square of the number of dimensions, meets on the driver. The spectrum is cut into search intervals
by inertia counts, and every interval is a row that a task solves by itself:

* a quadrature of the resolvent along a circle around the interval, ``sum of w (zI - V)^-1 Y`` over complex
  shifts z, projects a few random vectors onto the eigenvectors inside;
* Rayleigh-Ritz extracts eigenvalues and vectors from the projection, which is refined until its residual is
  down to rounding;
* the number of values found must equal the difference of the inertia counts at the ends of the interval. An
  interval that misses one is cut elsewhere and solved again.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
NODES = 8  # quadrature points on the upper half of the circle
EACH = 8  # eigenvalues that an interval may hold before it is cut
CLOSE = 1e-6  # of the matrix: eigenvalues as close as this stay in one interval, however many they are
ROUNDS = 60  # refinements of one interval
TRIES = 6  # other cuts for intervals that missed a value
SEED = 12
ROWS_OUT = 2048  # input rows per batch of results


# -- inertia ---------------------------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder reflections)."""
    a = np.array(matrix, dtype=float)
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0.0 or not np.any(v[1:]):
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1:, k:] -= 2.0 * np.outer(v, v @ a[k + 1:, k:])
        a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, at: float) -> int:
    """Eigenvalues greater than ``at``: the positive pivots of the shifted matrix (Sylvester's law of inertia)."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = 0, 1.0
    for i in range(len(diagonal)):
        pivot = diagonal[i] - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0.0
    return count


def search_intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int, nudge: float = 0.0) -> list[tuple[float, float, int]]:
    """Intervals (low, high, values inside) that hold at least the ``wanted`` largest eigenvalues, from the top down.

    ``nudge`` moves the cuts, so that another try does not cut at the same eigenvalue. Equal eigenvalues stay
    together, however many they are.
    """
    n = len(diagonal)
    reach = np.abs(diagonal) + np.append(np.abs(off), 0.0) + np.append(0.0, np.abs(off))
    size = float(reach.max(initial=0.0))
    top, bottom = size * (1.0 + 1e-6), -size * (1.0 + 1e-6)
    count = lambda t: above(diagonal, off, t)
    out: list[tuple[float, float, int]] = []
    todo, found = [(bottom, top, n, 0)], 0
    while todo and found < wanted:
        low, high, below_low, above_high = todo.pop()
        inside = below_low - above_high
        if not inside:
            continue
        if inside > EACH and high - low > CLOSE * size:
            mid = low + (high - low) * (0.5 + nudge)
            m = count(mid)
            todo += [(low, mid, below_low, m), (mid, high, m, above_high)]
            continue
        out.append((low, high, inside))
        found += inside
    return out


# -- contour integration -----------------------------------------------------------------------------------------


def eigenpairs(matrix: np.ndarray, low: float, high: float, inside: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues within (low, high] from the top down, and their unit vectors as columns."""
    n = len(matrix)
    size = np.linalg.norm(matrix, 2) if n <= 256 else np.linalg.norm(matrix)
    width = min(n, 2 * inside + 4)
    basis = np.random.default_rng([SEED, seed]).standard_normal((n, width))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.exp(1j * np.pi / 2 * (1.0 - points))
    middle, radius = (low + high) / 2, max((high - low) / 2, 1e-14 * size)
    best, values, vectors = np.inf, np.empty(0), np.empty((n, 0))
    stalled = 0
    for turn in range(ROUNDS):
        projected = np.zeros_like(basis)
        for w, angle in zip(weights, angles):
            shifted = (middle + radius * angle) * np.eye(n) - matrix
            projected += w / 2 * (radius * angle * np.linalg.solve(shifted, basis.astype(complex))).real
        u, s, _ = np.linalg.svd(projected, full_matrices=False)
        q = u[:, s > 1e-14 * s[0]]
        ritz, inner = np.linalg.eigh(q.T @ matrix @ q)
        ritz, basis = ritz[::-1], (q @ inner)[:, ::-1]
        kept = (ritz > low) & (ritz <= high)
        residual = np.linalg.norm(matrix @ basis[:, kept] - basis[:, kept] * ritz[kept], axis=0).max(initial=0.0)
        complete = kept.sum() == inside
        if complete and residual < best:
            stalled = 0 if residual < 0.5 * best else stalled + 1
            best, values, vectors = residual, ritz[kept], basis[:, kept]
        else:
            stalled += complete
        if complete and (best <= 2e-15 * size or (stalled >= 2 and best <= 1e-12 * size)):
            break
        if basis.shape[1] < width:  # directions that the filter wiped out start anew
            fresh = np.random.default_rng([SEED, seed, turn + 1]).standard_normal((n, width - basis.shape[1]))
            basis = np.concatenate([basis, fresh], axis=1)
    return (values, vectors) if best <= 1e-10 * size else (np.empty(0), np.empty((n, 0)))


def components(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and unit vectors as rows.

    Each search interval is solved by one task. The largest entry of a vector is positive.
    """
    n = len(matrix)
    wanted = min(wanted, n)
    if not wanted or not np.any(matrix):
        return np.zeros(wanted), np.eye(n)[:wanted]
    diagonal, off = tridiagonal(matrix)
    sent = spark.sparkContext.broadcast(matrix)  # the square of the number of dimensions

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                values, vectors = eigenpairs(sent.value, row.low, row.high, row.inside, row.part)
                if len(values):
                    yield pd.DataFrame({"part": np.full(len(values), row.part), "value": values, "vector": list(vectors.T)})

    for turn in range(TRIES):
        nudge = 0.0 if not turn else (-1) ** turn * 0.03 * turn
        parts = search_intervals(diagonal, off, wanted, nudge)
        rows = [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(parts)]
        found = (spark.createDataFrame(rows, "part int, low double, high double, inside int")
                 .repartition(len(rows), "part").mapInPandas(solve, "part int, value double, vector array<double>").collect())
        sent_counts = {i: c for i, _, _, c in rows}
        got = {i: sum(r.part == i for r in found) for i in sent_counts}
        if got != sent_counts:
            continue
        found.sort(key=lambda r: -r.value)
        vectors = np.array([r.vector for r in found])
        if np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() > 1e-4:
            continue  # one value was found on both sides of a cut
        # neighbours across a cut are orthogonal to rounding only after this
        q, r = np.linalg.qr(vectors.T)
        vectors = (q * np.sign(np.diag(r))).T[:wanted]
        values = np.einsum("ij,jk,ik->i", vectors, matrix, vectors)
        sign = np.sign(vectors[np.arange(wanted), np.abs(vectors).argmax(1)])
        return values, vectors * sign[:, None]
    raise ArithmeticError("the inertia counts and the eigenvalues found differ")


# -- passes over the vectors ---------------------------------------------------------------------------------------


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) of every entry as a long; null for vectors that are null or hold an entry that is null, not finite
    or too large for a long."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0 ** 55))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; entries that a shorter vector lacks are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Centre:
    """Row count n and sums S of the fit list; ``n x - S`` of vectors, exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # S / n, rounded
        self.rest = np.array([s - n * int(c) for s, c in zip(sums, self.near)], np.int64)  # at most n / 2

    def centred(self, x: np.ndarray) -> np.ndarray:
        """(n x - S) / n in doubles, from whole numbers."""
        return (x - self.near) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions; None where it is beyond a long."""
        rough = ((self.centred(x) * self.n) ** 2).sum(1)
        out: list[int | None] = []
        safe = rough < 2.0 ** 62
        exact = ((self.n * (x[safe] - self.near) - self.rest) ** 2).sum(1) if safe.any() else np.empty(0, np.int64)
        fast = iter(exact.tolist())
        for row, ok in zip(x, safe):
            if ok:
                out.append(next(fast))
                continue
            total = sum((self.n * (int(v) - int(c)) - int(r)) ** 2 for v, c, r in zip(row, self.near, self.rest))
            out.append(total if total < 1 << 63 else None)
        return out


def _sums(rows: DataFrame, width: int) -> list[int]:
    """Exact sums per dimension: the halves of every number are added up apart, so that no sum overflows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = [0] * width, [0] * width
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            for total, part in ((high, (x >> 31).sum(0)), (low, (x & 0x7FFFFFFF).sum(0))):
                total[:] = [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array(range(width), pa.int32()),
            "total": pa.array([Decimal((h << 31) + l) for h, l in zip(high, low)], pa.decimal128(38, 0))})

    found = rows.select("x").mapInArrow(partial, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
    sums = {r.dim: int(r.total) for r in found.collect()}
    return [sums[i] for i in range(width)]


def _products(rows: DataFrame, width: int, vectors) -> np.ndarray:
    """The mean of the outer products of ``vectors(batch)``, rows of ``width`` doubles; ``n`` is their number.

    A task adds up its products; the entries of the upper triangle are then added per place.
    """
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            d = vectors(batch)
            total += d.T @ d
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(upper[0]), dtype=np.int64), "total": total[upper]})

    found = (rows.select("x").mapInArrow(partial, "place long, total double")
             .groupBy("place").agg(F.sum("total").alias("total")).toPandas())
    out = np.zeros((width, width))
    place = found["place"].to_numpy()
    out[upper[0][place], upper[1][place]] = out[upper[1][place], upper[0][place]] = found["total"].to_numpy()
    return out


def whiten(vectors: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component.

    Vectors that are null or hold an entry that is null, not finite or beyond 2^55 are dropped; every other row
    counts, whatever its id (null and repeated ids included). A vector shorter than the longest is filled with
    zeros. Entries are whole numbers x = floor(64 c) + 1000000; since sums and products are of n x - S, the
    addend cancels exactly and is left out. Components whose variance is zero to rounding have a null ``whitened``
    and do not count for ``identity_error``; equal eigenvalues have an arbitrary basis. ``deviation`` is null
    where it is beyond a long. An empty table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(
        vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x"))
        .filter("x is not null"), "whole-vectors")
    schema = T.StructType.fromDDL(
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not width:
        return spark.createDataFrame([], schema)
    centre = Centre(n, _sums(rows, width))
    matrix = _products(rows, width, lambda batch: centre.centred(_matrix(batch.column("x"), width))) / n
    values, axes = components(spark, matrix, count)
    trace = float(np.trace(matrix))
    live = values > width * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    scale = np.where(live, 1.0 / np.sqrt(np.where(live, values, 1.0)), np.nan)
    project = axes * scale[:, None]
    used = project[live]
    error = None
    if live.any():
        shape = len(used)
        # with a column of ones, the products also hold the sums, so that the mean is taken off exactly
        whitened = lambda batch: np.concatenate([
            centre.centred(_matrix(batch.column("x"), width)) @ used.T, np.ones((batch.num_rows, 1))], axis=1)
        sums = _products(rows, shape + 1, whitened) / n
        error = float(np.abs(sums[:shape, :shape] - np.outer(sums[-1, :shape], sums[-1, :shape]) - np.eye(shape)).max())
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    some = len(values)
    shown = T.StructType(schema.fields)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                x, m = _matrix(part.column("x"), width), part.num_rows
                each = pa.array(np.repeat(np.arange(m), some))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * some, n, np.int64)), pa.array(centre.deviation(x), pa.int64()).take(each),
                    pa.array((centre.centred(x) @ project.T).ravel(), from_pandas=True),
                    pa.array(np.tile(explained, m), from_pandas=True),
                    pa.array([error] * (m * some), pa.float64())], names=shown.names)

    return rows.mapInArrow(emit, schema)
