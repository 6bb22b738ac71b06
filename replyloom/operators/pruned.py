"""Exact search over a stored cell index that leaves out cells which cannot matter.

A cell's radius is the greatest distance of its vectors from the centre. By the triangle inequality
no vector in it has a product with a query above ``q.c + |q| r``. Every query first visits the cells
with the highest bounds; the similarity of its ``k``-th hit there is what any other vector has to
reach, and only cells whose bound reaches it are visited then. The result is that of the search over
all rows, however the cells were made; how many visits it saves depends on the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from replyloom import constants as K
from replyloom.operators.cells import CellIndex, stored_cells, visit
from replyloom.operators.meeting import _SCALE, _matrix
from replyloom.operators.retrieve import BLOCK_ROWS, _query_side, _ranked
from replyloom.schemas import HITS
from replyloom.session import materialise, ship_package

#: Cells that every query visits before the others are judged.
FIRST_CELLS = 2


@dataclass(frozen=True)
class Radii:
    """Centre, radius and row count of every cell that has rows."""

    cells: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    rows: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest product of each query (row) with any vector of each cell (column)."""
        reach = np.linalg.norm(queries, axis=1)[:, None] * self.radii
        return queries @ self.centres.T + reach

    def chosen(self, queries: np.ndarray, least: np.ndarray | None, rest: bool) -> np.ndarray:
        """Which cells each query visits: the first ones, or all others that can reach ``least``."""
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        chosen = np.zeros(bounds.shape, bool)
        np.put_along_axis(chosen, order[:, :FIRST_CELLS], True, axis=1)
        if rest:
            # Similarities are compared rounded; a null asks for everything.
            reach = bounds + 1 / _SCALE >= np.where(np.isnan(least), -np.inf, least)[:, None]
            chosen = reach & ~chosen
        return chosen


def measure_radii(index: CellIndex, stored: DataFrame) -> Radii:
    """One pass over the stored rows; a row per cell reaches the driver."""
    ship_package(stored.sparkSession)
    shared = stored.sparkSession.sparkContext.broadcast(index.centres)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(0).to_numpy()
            left = _matrix(batch.column(1)) - shared.value[cells]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.astype(np.int32)), pa.array(np.linalg.norm(left, axis=1))],
                names=["cell", "distance"])

    found = (stored.select(F.col("cell").cast("int").alias("cell"), "embedding")
             .mapInArrow(run, "cell int, distance double")
             .groupBy("cell").agg(F.max("distance").alias("r"), F.count(F.lit(1)).alias("n"))
             .orderBy("cell").toPandas())
    cells = found["cell"].to_numpy()
    # A little more than the rounding of sums and square roots.
    return Radii(cells, index.centres[cells], found["r"].to_numpy() + 1e-9, found["n"].to_numpy())


def _visits(queries: DataFrame, radii: Radii, rest: bool) -> DataFrame:
    """One row per query and cell that it visits, to count them; the search makes no such rows."""
    ship_package(queries.sparkSession)
    shared = queries.sparkSession.sparkContext.broadcast(radii)
    schema = T.StructType([*queries.schema.fields,
                           T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch, known = whole.slice(lo, 512), shared.value
                least = batch.column(batch.schema.get_field_index("least")).to_numpy(
                    zero_copy_only=False).astype(float) if rest else None
                chosen = known.chosen(
                    _matrix(batch.column(batch.schema.get_field_index("embedding"))), least, rest)
                row, at = np.nonzero(chosen)
                ends = np.searchsorted(row, np.arange(len(chosen) + 1)).astype(np.int32)
                cells = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(known.cells[at].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells],
                                                 names=[*batch.schema.names, "cells"])

    return queries.mapInArrow(run, schema).select(
        "query_id", "exclude_id", "embedding", F.explode("cells").alias("cell"))


def _visiting(spark, radii: Radii, rest: bool):
    """The choice of :meth:`Radii.chosen` by cell number, for :func:`cells.visit`."""
    shared = spark.sparkContext.broadcast(radii)

    def chosen(vectors: np.ndarray, least: np.ndarray | None) -> np.ndarray:
        known = shared.value
        visited = np.zeros((len(vectors), int(known.cells.max()) + 1), bool)
        visited[:, known.cells] = known.chosen(vectors, least, rest)
        return visited

    return chosen


@dataclass(frozen=True)
class PrunedSearch:
    """Hits, and how many of all (query, row) products were computed for them."""

    hits: DataFrame
    visits: DataFrame
    radii: Radii

    def visited_share(self) -> float:
        """Share of the products of all queries with all rows that the visits computed."""
        rows = self.hits.sparkSession.createDataFrame(
            list(zip(self.radii.cells.tolist(), self.radii.rows.tolist())), "cell int, n long")
        done = self.visits.groupBy("cell").count().join(F.broadcast(rows), "cell").agg(
            F.sum(F.col("count") * F.col("n"))).first()[0] or 0
        queries = self.visits.select("query_id").distinct().count()
        return done / max(1, queries * int(self.radii.rows.sum()))


def pruned_search(queries: DataFrame, index: CellIndex, encoder: str, k: int = K.TOP_K, *,
                  block_rows: int = BLOCK_ROWS) -> PrunedSearch:
    """The rows of :func:`replyloom.operators.retrieve.knn_exact` from a stored index.

    ``encoder`` has to be the index's own. Which cells a query visits is found in the task that
    holds it, so what is shuffled follows the queries and not their visits.
    """
    if encoder != index.encoder:
        raise ValueError(f"queries are encoded by {encoder!r}, the index by {index.encoder!r}")
    spark = queries.sparkSession
    asked = materialise(_query_side(queries))
    stored = index.corpus(spark) if index.centres.shape[1] else None
    radii = measure_radii(index, stored) if stored is not None else None
    if radii is None or not len(radii.cells):
        none = spark.createDataFrame([], HITS)
        nowhere = Radii(np.zeros(0, int), index.centres[:0], np.zeros(0), np.zeros(0, int))
        return PrunedSearch(_ranked(none, k), asked.withColumn("cell", F.lit(0)).limit(0), nowhere)
    rows = stored_cells(index, spark)
    hits = materialise(_ranked(visit(asked, rows, _visiting(spark, radii, False), k, block_rows), k))
    least = hits.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))
    again = asked.join(least, "query_id", "left")
    found = hits.drop("rank").unionByName(
        visit(again, rows, _visiting(spark, radii, True), k, block_rows))
    visits = _visits(asked, radii, False).unionByName(_visits(again, radii, True))
    return PrunedSearch(_ranked(found, k), visits, radii)


def knn_pruned(queries: DataFrame, index: CellIndex, encoder: str, k: int = K.TOP_K, *,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The hits of :func:`pruned_search`."""
    return pruned_search(queries, index, encoder, k, block_rows=block_rows).hits
