"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Vectors are taken as whole numbers, so sums are exact. The scatter is summed in tasks from
centred values, and only it and the sums (sizes set by the dimension, not by the rows) come
to the driver. The scatter's Cholesky factor, pivoted, shows its rank; rotations of the
factor's columns make them orthogonal, after which their squared norms are the eigenvalues
and the columns, normalised, the components. Small eigenvalues keep their relative accuracy,
as the product of the factor with itself is never formed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Entries become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: An entry this large or larger counts as non-finite, since its whole number could not be exact.
LARGEST = 2.0 ** 50
COMPONENTS = 32
SWEEPS = 60


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L'; L has as many columns as a has rank."""
    a = a.copy()
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(a.diagonal()[k:].argmax())
        if a[p, p] <= least:
            return factor[:, :k], order
        for m in (a, a.T, factor, order):
            m[[k, p]] = m[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1:, k] = a[k + 1:, k] / factor[k, k]
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def _pairings(r: int):
    """Rounds in which every two of ``r`` columns meet once, in pairs that share none."""
    seats = list(range(r + r % 2))
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[:len(seats) // 2], seats[:len(seats) // 2 - 1:-1]) if max(a, b) < r]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        seats.insert(1, seats.pop())


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(e, u): eigenvalues of factor factor' by falling size, and unit eigenvectors as columns."""
    x, eps = factor.copy(), np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for i, j in _pairings(x.shape[1]):
            if not len(i):
                continue
            a, b = x[:, i], x[:, j]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(gamma) > eps * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = np.where(turn, 1 / np.hypot(1, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            x[:, i], x[:, j] = c * a - s * b, s * a + c * b
        if not turned:
            break
    e = (x * x).sum(0)
    by = np.argsort(-e, kind="stable")
    return e[by], x[:, by] / np.sqrt(e[by])


@dataclass
class Whitening:
    """What whitens a vector: the number of vectors and sums they were fitted on, eigenvalues
    and components (as columns), and the trace of the covariance."""
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def __post_init__(self):
        # x - S/n as a whole and a small rest, both exact or nearly so
        self.centre = np.array([round_div(s, self.n) for s in self.sums], np.int64)
        self.rest = [s - self.n * int(c) for s, c in zip(self.sums, self.centre)]
        self.shift = np.array([r / self.n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(np.float64) - self.shift

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; null where no long holds it."""
        y = x - self.centre
        if (self.n * (float(np.abs(y).max(initial=0)) + 1)) ** 2 * max(1, x.shape[1]) < 2.0 ** 62:
            z = self.n * y - np.array(self.rest, np.int64)
            return (z * z).sum(1).tolist()
        rows = ([self.n * int(a) - r for a, r in zip(row, self.rest)] for row in y)
        exact = (sum(z * z for z in row) for row in rows)
        return [v if v < 2 ** 63 else None for v in exact]


def round_div(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def whole_vectors(batch: pa.RecordBatch, column: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows of a batch whose vector counts, and their whole numbers."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dims)
    values = lists.take(pa.array(rows)).flatten()
    c = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dims)
    good = (np.abs(c) < LARGEST).all(axis=1) & np.isfinite(c).all(axis=1)
    return rows[good], np.floor(SCALE * c[good]).astype(np.int64) + OFFSET


def common_dimension(vectors: DataFrame, column: str) -> int:
    """The commonest length of the vectors that are not empty, of several the largest; 0 without any."""
    sizes = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return first[0] if first else 0


def _sums(vectors: DataFrame, column: str, dims: int, values) -> tuple[int, list]:
    """Number of vectors and sums of values(x) by column; exact for whole numbers."""
    def run(batches):
        n, high, low = 0, 0, 0
        for batch in batches:
            v = values(whole_vectors(batch, column, dims)[1])
            n += len(v)
            # halves, so that no sum of a task overflows
            high = high + (np.floor_divide(v, 1 << 20) if v.dtype == np.int64 else v).sum(0)
            low = low + (v % (1 << 20) if v.dtype == np.int64 else v * 0).sum(0)
        if n:
            kind = pa.int64() if high.dtype == np.int64 else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(high)), pa.int32()), pa.array([n] * len(high), pa.int64()), pa.array(high, kind), pa.array(low, kind)], ["i", "n", "high", "low"])

    whole = values(np.zeros((1, dims), np.int64)).dtype == np.int64
    parts = vectors.select(column).mapInArrow(run, "i int, n long, " + ("high long, low long" if whole else "high double, low double"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)") if whole else F.col(c)).alias(c)
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), total("high"), total("low")).orderBy("i").collect()  # one a column
    if not rows:
        return 0, []
    return rows[0].n, [int(r.high) * (1 << 20) + int(r.low) if whole else r.high for r in rows]


def _scatter(vectors: DataFrame, column: str, dims: int, values) -> np.ndarray:
    """Sum of the outer products of values(x), which are centred; tasks send one row for each
    pair of columns, which Spark adds up before and after the shuffle."""
    size = values(np.zeros((1, dims), np.int64)).shape[1]
    i, j = np.triu_indices(size)

    def run(batches):
        total = None
        for batch in batches:
            v = values(whole_vectors(batch, column, dims)[1])
            total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], ["i", "j", "v"])

    found = vectors.select(column).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    out[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("v").to_numpy()
    return np.triu(out) + np.triu(out, 1).T


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors that count: not null, of the commonest length, and without
    null, non-finite or huge entries. None where there is none. Components that the data do
    not have (zero variance) are left out, so there may be fewer than asked for."""
    dims = common_dimension(vectors, column)
    n, sums = _sums(vectors, column, dims, lambda x: x) if dims else (0, [])
    if not n:
        return None
    whole = Whitening(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    covariance = _scatter(vectors, column, dims, whole.centred) / n
    factor, order = pivoted_cholesky(covariance)
    e, rotated = one_sided_jacobi(factor)
    units = np.empty_like(rotated)
    units[order] = rotated
    return Whitening(n, sums, e[:components], units[:, :components], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, fitted: Whitening, column: str = "embedding") -> float:
    """Largest entry of the whitened vectors' covariance less the identity."""
    dims = len(fitted.sums)
    n, sums = _sums(vectors, column, dims, fitted.whiten)
    mean = np.array(sums) / n
    covariance = _scatter(vectors, column, dims, lambda x: fitted.whiten(x) - mean) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector that counts and each component: id, component from 1, n,
    deviation (null beyond a long), whitened, explained and identity_error.

    Repeated and null ids stay; other columns are not read; vectors that do not count have no
    row; an empty table, or vectors that are all equal, give none.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit_whitening(vectors, column, components)
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error, dims, k = identity_error(vectors, fitted, column), len(fitted.sums), len(fitted.values)
    explained = fitted.values / fitted.trace

    def run(batches):
        for batch in batches:
            rows, x = whole_vectors(batch, column, dims)
            if not len(rows):
                continue
            each = np.repeat(np.arange(len(rows)), k)
            cols = [batch.column(id_col).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                    pa.array(np.full(len(each), fitted.n), pa.int64()), pa.array(fitted.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(fitted.whiten(x).ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(each), error))]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(id_col, column).mapInArrow(run, schema)
