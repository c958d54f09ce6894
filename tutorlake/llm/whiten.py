"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

1. Every entry c becomes the integer x = floor(1024 * c) + 100000. Numbers of vectors and sums for
   each dimension are exact integers, summed by Spark.
2. Each task adds up products of vectors centred at the nearest integer to the mean, exactly; Spark
   adds those sums, and what the mean differs from that integer (half at most) is taken off. So the
   scatter is the same however the rows are dealt out.
3. Pivoted Cholesky writes the covariance as L L^T, largest remaining variance first, and stops where
   only rounding remains: that is its rank. One-sided Jacobi turns the columns of L until they are
   orthogonal. Their squared norms are the eigenvalues, the columns over their norms the components.
4. Whitened vectors are projections of x - S / n over the root of the eigenvalue. A last pass adds up
   their covariance, whose largest difference from the identity is told.

The driver sees sums by dimension and by pair of dimensions, nothing that grows with the rows. Rows
with a null vector, a vector without entries, or null or non-finite entries (from 2**40 on) have no part
in anything. All other vectors must have as many entries as one another; else the query fails and says
so. Components without variance cannot be whitened and are left out, as is everything if no vector
remains. ``deviation`` is null where it exceeds 64 bits. Null and repeated keys stay as they are;
equal vectors each count. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries of this size or more are as good as infinite: their squares cannot be summed exactly.
LARGEST = float(1 << 40)
#: Vectors of a matrix product.
ROWS = 4096


def usable(v: Column) -> Column:
    """Has entries, all of them finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))


def integers(v: Column) -> Column:
    return F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)


# --- sums ---------------------------------------------------------------------------------------
def _matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The vectors of a batch as matrices of at most ROWS rows."""
    for lo in range(0, batch.num_rows, ROWS):
        x = batch.column("x").slice(lo, ROWS)
        yield x.flatten().to_numpy().reshape(len(x), -1)


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, object]:
    """The sum of ``of`` (a flat array) over the matrices of ``rows`` (x): added within each task, then by Spark."""
    out = pa.schema([("at", pa.int32()), ("v", pa.float64() if kind == "double" else pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _matrices(batch):
                got = of(x)
                total = got if total is None else total + got
        if total is not None:
            v = total.tolist() if kind == "double" else list(map(str, total.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(v)], schema=out)

    cast = "double" if kind == "double" else "decimal(38,0)"
    got = rows.mapInArrow(run, f"at int, v {'double' if kind == 'double' else 'string'}").groupBy("at").agg(F.sum(F.col("v").cast(cast)).alias("v"))
    return {r["at"]: r["v"] for r in got.collect()}


def _exact(x: np.ndarray) -> np.ndarray:
    """Integers as Python's, so that sums of any length are exact."""
    return x.astype(object)


def _products(y: np.ndarray) -> np.ndarray:
    """The upper triangle of y^T y, exact: in doubles where no sum can leave 53 bits."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < 1 << 53:
        full = np.rint(y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
    else:
        full = _exact(y).T @ _exact(y)
    return _exact(full[np.triu_indices(y.shape[1])])


def moments(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, sums by dimension, covariance with divisor n) of the vectors in ``rows`` (x); at least one row."""
    sized = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    n, d = sized["n"], sized["high"]
    if sized["low"] != d:
        raise ValueError(f"vectors of {sized['low']} and of {d} entries in one table")
    got = _summed(rows, lambda x: _exact(x.sum(0)), "exact")
    sums = [int(got[i]) for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    near = np.array(centre, np.int64)
    got = _summed(rows, lambda x: _products(x - near), "exact")
    off = np.array([(s - n * c) / n for s, c in zip(sums, centre)])
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = [int(got[i]) / n for i in range(d * (d + 1) // 2)]
    cov = cov + np.triu(cov, 1).T
    return n, sums, cov - np.outer(off, off)


# --- eigenvectors -------------------------------------------------------------------------------
def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (d, rank) with L L^T = a, rows in the order of ``a``: in each step the dimension with the
    largest variance that the columns so far leave."""
    d = len(a)
    left, rest = np.diag(a).astype(np.float64).copy(), a.astype(np.float64)
    least = d * np.finfo(np.float64).eps * max(left.max(initial=0.0), 0.0)
    columns = []
    for _ in range(d):
        p = int(left.argmax())
        if left[p] <= least:
            break
        done = np.array([c[p] for c in columns])
        column = (rest[:, p] - (np.array(columns).T @ done if columns else 0.0)) / np.sqrt(left[p])
        column[left < 0] = 0.0  # pivots before: their rows of the factor are complete
        column[p] = np.sqrt(left[p])
        columns.append(column)
        left = np.where(left >= 0, np.maximum(left - column**2, 0.0), left)
        left[p] = -1.0
    return np.array(columns).T.reshape(d, len(columns))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, components as columns) of factor factor^T: plane rotations make the columns
    orthogonal, in rounds of disjoint pairs that meet as in a tournament."""
    m = factor.copy()
    r = m.shape[1]
    order = list(range(r + r % 2))
    for _ in range(sweeps if r > 1 else 0):
        turned = False
        for _ in range(len(order) - 1):
            i, j = np.array([p for p in zip(order[: len(order) // 2], reversed(order[len(order) // 2 :])) if max(p) < r]).T
            order = [order[0], order[-1], *order[1:-1]]
            x, y = m[:, i], m[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(c) > 1e-15 * np.sqrt(a * b)
            if not turn.any():
                continue
            turned = True
            i, j, x, y, a, b, c = i[turn], j[turn], x[:, turn], y[:, turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2.0 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1.0 / np.hypot(1.0, t)
            m[:, i], m[:, j] = cos * (x - t * y), cos * (y + t * x)
        if not turned:
            break
    norms = np.sqrt((m * m).sum(0))
    first = np.argsort(-norms, kind="stable")
    return norms[first] ** 2, m[:, first] / norms[first]


# --- the operator -------------------------------------------------------------------------------
def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and
    each of the first components that has a variance."""
    v = F.col(vector)
    rows = df.where(usable(v)).select(F.col(key).alias("vec_id"), integers(v).alias("x"))
    kind = df.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    n, sums, cov = moments(rows.select("x"))
    values, vectors = one_sided_jacobi(pivoted_cholesky(cov))
    k = min(components, len(values))
    values, onto, explained = values[:k], vectors[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(cov)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    off = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre)])

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - centre).astype(np.float64) - off) @ onto

    mean = _summed(rows.select("x"), lambda x: project(x).sum(0), "double") if k else {}
    mean = np.array([mean[i] / n for i in range(k)])

    def spread(x: np.ndarray) -> np.ndarray:
        w = project(x) - mean
        return (w.T @ w).ravel()

    found = _summed(rows.select("x"), spread, "double") if k else {}
    error = float(np.abs(np.array([found[i] / n for i in range(k * k)]).reshape(k, k) - np.eye(k)).max(initial=0.0))
    exact_sums = np.array(sums, object)

    def deviations(x: np.ndarray) -> list[int | None]:
        if n * float(np.abs(x).max(initial=0)) < 1 << 60 and max(map(abs, sums)) < 1 << 60:
            y = n * x - exact_sums.astype(np.int64)
            if float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 62:
                return (y * y).sum(1).tolist()
        y = n * _exact(x) - exact_sums
        return [s if s < 1 << 63 else None for s in (y * y).sum(1).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x in zip(range(0, batch.num_rows, ROWS), _matrices(batch)):
                keys, m = batch.column("vec_id").slice(lo, ROWS), len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array([v for v in deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
