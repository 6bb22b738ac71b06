"""Whitening of embeddings through blockwise QR and a bidiagonal qd solver.

Rows become integers, so their count and sums are exact. Every task reduces its centred rows to one
triangular factor by QR of bounded blocks, factors are stacked and reduced again in groups, and the
last one, whose size depends on the dimension alone, is bidiagonalised and solved by dqds and
twisted factorisations (:mod:`bidiagonal`). The covariance is never multiplied out, so small
components keep their accuracy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.bidiagonal import right_singular
from replyloom.llm.common import Scratch, field
from replyloom.llm.vectors import common_length, finite_rows, matrices

#: Grid of the integers: entry c becomes floor(1024 c) + 100000.
GRID = 1024
OFFSET = 100_000
#: Entries beyond this many grid steps count as this many.
MOST_STEPS = 2.0 ** 40
#: Bytes of triangular factors that one task stacks.
STACK_BYTES = 1 << 26
#: A singular value below this share of the largest is rounding, not a direction.
RANK_TOLERANCE = 1e-12


def on_grid(vectors: np.ndarray) -> np.ndarray:
    steps = np.clip(np.floor(GRID * vectors), -MOST_STEPS, MOST_STEPS)
    return steps.astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Fit:
    """Count and sums of the integer vectors, unit directions as columns and their variances."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def scales(self) -> np.ndarray:
        """Deviation of each component; NaN where there is none beyond rounding."""
        least = self.variances[:1] * RANK_TOLERANCE ** 2
        good = (self.variances > least) & (self.variances > 0)
        return np.sqrt(np.where(good, self.variances, np.nan))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / self.scales()


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - sums / n``; the whole part is taken off as integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole) - rest


def _sums(batches: Iterable[pa.RecordBatch], col: str, width: int) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(width, object), 0
    for _, vectors in matrices(batches, col, width):
        total += on_grid(vectors).sum(axis=0).astype(object)
        n += len(vectors)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(width), pa.int32()), pa.array([int(t) for t in total], pa.int64()),
         pa.array([n] * width, pa.int64())], names=["dim", "total", "n"])


def _reduced(stack: np.ndarray, width: int) -> np.ndarray:
    """Triangular factor of ``stack`` with ``width`` rows, zeros below."""
    factor = np.linalg.qr(stack, mode="r")
    return np.vstack([factor, np.zeros((width - len(factor), width))])


def _factors(batches: Iterable[pa.RecordBatch], col: str, width: int, n: int,
             sums: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    factor = None
    for _, vectors in matrices(batches, col, width):
        rows = _centred(on_grid(vectors), n, sums)
        factor = _reduced(rows if factor is None else np.vstack([factor, rows]), width)
    if factor is not None:
        yield pa.RecordBatch.from_arrays([pa.array([factor.tobytes()], pa.binary())],
                                         names=["factor"])


def _stacked(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    stack = np.vstack([np.frombuffer(f).reshape(width, width) for f in frame["factor"]])
    return pd.DataFrame({"factor": [_reduced(stack, width).tobytes()]})


def _one_factor(scratch: Scratch, factors: DataFrame, width: int) -> np.ndarray:
    """The factor of all rows: groups of factors are reduced until one group is left."""
    fan = max(2, STACK_BYTES // (8 * width * width))
    left = scratch.write(factors, "factors")
    while (count := left.count()) > fan:
        groups = -(-count // fan)
        # A written table keeps its order within a task, and its rows are dealt out evenly.
        left = scratch.write(
            left.withColumn("group", F.pmod(F.xxhash64("factor"), F.lit(groups)))
            .groupBy("group").applyInPandas(
                lambda frame: _stacked(frame, width), "factor binary"), "factors")
    rows = left.toPandas().sort_values("factor")
    return np.frombuffer(_stacked(rows, width)["factor"][0]).reshape(width, width)


def fit_whitening(scratch: Scratch, vectors: DataFrame, col: str, width: int,
                  most: int) -> Fit | None:
    """Directions of the vectors of ``width`` entries; None without rows or entries."""
    if not width:
        return None
    found = vectors.mapInArrow(lambda it: _sums(it, col, width), "dim int, total long, n long"
                               ).groupBy("dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    ).orderBy("dim").collect()  # one row a dimension
    n, sums = found[0]["n"], tuple(int(r["total"]) for r in found)
    factor = _one_factor(scratch, vectors.mapInArrow(
        lambda it: _factors(it, col, width, n, sums), "factor binary"), width)
    squares, directions = right_singular(factor, most)
    variances = squares / n
    return Fit(n, sums, directions, variances[:directions.shape[1]], float(variances.sum()))


def _products(batches: Iterable[pa.RecordBatch], col: str, width: int,
              fit: Fit) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened rows and of their products, per task."""
    k = len(fit.variances)
    first, second = np.zeros(k), np.zeros((k, k))
    for _, vectors in matrices(batches, col, width):
        w = fit.whitened(on_grid(vectors))
        first += w.sum(axis=0)
        second += w.T @ w
    values = np.concatenate([first, second.ravel()])
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["at", "value"])


def identity_error(vectors: DataFrame, col: str, width: int, fit: Fit) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity.

    Null if no component has any variance. The rows are whitened once more for it, around a mean
    that is zero but for rounding, which is taken off again here.
    """
    k = len(fit.variances)
    sums = vectors.mapInArrow(lambda it: _products(it, col, width, fit), "at int, value double"
                              ).groupBy("at").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(k + k * k)
    for row in sums:
        values[row["at"]] = row["value"]
    mean, second = values[:k] / fit.n, values[k:].reshape(k, k) / fit.n
    good = ~np.isnan(fit.scales())
    if not good.any():
        return None
    error = np.abs(second - np.outer(mean, mean) - np.eye(k))
    return float(error[np.ix_(good, good)].max())


def _deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Sums of (n x - S)**2 as exact integers; None where a long cannot hold it."""
    sums = np.array(fit.sums, object)
    far = max(int(np.abs(x).max(initial=0)) * fit.n, *(abs(s) for s in fit.sums)) * 2
    if far < 1 << 62:
        y = x * fit.n - sums.astype(np.int64)
        if float(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 2.0 ** 62:
            return (y * y).sum(axis=1).tolist()
        y = y.astype(object)
    else:
        y = x.astype(object) * fit.n - sums
    return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]


def _written(batches: Iterable[pa.RecordBatch], id_col: str, col: str, width: int, fit: Fit,
             error: float | None) -> Iterator[pa.RecordBatch]:
    k = len(fit.variances)
    shares = fit.variances / fit.total if fit.total > 0 else np.full(k, np.nan)
    for part, vectors in matrices(batches, col, width):
        x = on_grid(vectors)
        rows = np.repeat(np.arange(len(x)), k)

        def tiled(values: np.ndarray) -> pa.Array:
            return pa.array(np.tile(values, len(x)), from_pandas=True)

        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index(id_col)).take(pa.array(rows)),
             tiled(np.arange(1, k + 1, dtype=np.int32)),
             pa.array(np.full(len(rows), fit.n)),
             pa.array(_deviations(x, fit), pa.int64()).take(pa.array(rows)),
             pa.array(fit.whitened(x).ravel(), from_pandas=True), tiled(shares),
             pa.array([error] * len(rows), pa.float64())],
            names=[id_col, "component", "n", "deviation", "whitened", "explained",
                   "identity_error"])


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = 8) -> DataFrame:
    """One row per vector and component with the coordinates of the whitened vectors.

    Columns: the id, ``component`` (from 1, by falling variance), ``n`` (vectors), ``deviation``
    (sum over dimensions of ``(n x - S)**2`` on the integer grid, exact; null beyond a long),
    ``whitened``, ``explained`` (share of the variance) and ``identity_error`` (largest entry of
    the whitened covariance minus the identity, one value).

    Null vectors, and vectors with null or non-finite entries, are left out. So are vectors that
    have not the most frequent length; an empty table, or one of empty vectors, gives no rows.
    Vectors of fewer entries than ``components`` have as many components as entries. A component
    without variance beyond rounding (one vector, equal vectors, fewer vectors than entries) has a
    null ``whitened``; if there is no variance at all, ``explained`` and ``identity_error`` are
    null too. Null ids stay null, repeated rows count and come back as often as they are there.
    Entries beyond 2**40 grid steps count as 2**40. Other columns are not read.
    """
    scratch = Scratch(table.sparkSession, "whitening")
    try:
        vectors = finite_rows(table.select(id_col, vector_col), vector_col)
        width = common_length(vectors, vector_col)
        vectors = vectors.filter(F.size(vector_col) == width)
        fit = fit_whitening(scratch, vectors, vector_col, width, components)
    finally:
        scratch.drop()
    schema = (f"{field(table, id_col)}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    if fit is None:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, vector_col, width, fit)
    return vectors.mapInArrow(
        lambda it: _written(it, id_col, vector_col, width, fit, error), schema)
