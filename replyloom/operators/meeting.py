"""Blocks of queries that meet all stored vectors without either side being shuffled to the other.

The stored side is written once. Every task takes a bounded block of queries, reads the stored files
batch by batch and keeps the best rows of each query, so that memory is that of one block and one
batch, and what is shuffled and written follows the two inputs and the hits, not their product.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from replyloom.schemas import HITS
from replyloom.session import scratch_path, ship_package

#: Most queries that a task holds, and fewest for which another task is made.
QUERY_ROWS, LEAST_ROWS = 4_096, 256
#: Most stored rows that are read at a time, and the fewest of a part of the files read by a task.
READ_ROWS, PART_ROWS = 4_096, 16_384
#: Tasks for each core that are wanted.
TASKS_PER_CORE = 3
#: Elements of one similarity matrix, and candidates scored exactly at a time.
_TILE, _EXACT_ROWS = 2_000_000, 50_000
#: Bytes of a row group: what a task holds of a file that it reads.
_ROW_GROUP = 8 << 20

# Similarities are compared after rounding to this many decimals (about single precision), so
# copies of one vector tie exactly and fall back to the id order on every engine.
_DECIMALS = 6
_SCALE = 10 ** _DECIMALS

_ARROW_HITS = pa.schema([("query_id", pa.string()), ("pair_id", pa.string()),
                         ("similarity", pa.float64())])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one Arrow list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


class Own:
    """Which rows of a batch a query must not find: those with its ``exclude_id``."""

    def __init__(self, own: pa.Array, ids: pa.Array) -> None:
        coded = ids.dictionary_encode(null_encoding="encode")
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.asked = pc.index_in(own, value_set=coded.dictionary).fill_null(-1).to_numpy(
            zero_copy_only=False)
        self.hidden = np.flatnonzero(self.asked >= 0)

    def hide(self, score: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """Lower the scores of the queries ``rows`` for their own rows among ``cols``."""
        for i in np.flatnonzero(self.asked[rows] >= 0):
            score[i, self.code[cols] == self.asked[rows[i]]] = -np.inf

    def mine(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return self.asked[rows] == self.code[cols]


class Best:
    """The ``k`` best rows of each query among all batches added so far.

    Products are taken in single precision first. ``floor`` is what a row has to reach to be among
    the ``k`` best; rows that reach it within the error of single precision are scored exactly.
    ``unique``, the rows that an id may have, keeps an id once for a query, with its best row.
    """

    def __init__(self, queries: pa.Table, k: int, least: np.ndarray | None = None,
                 unique: int = 0) -> None:
        self.ids = queries.column("query_id").combine_chunks()
        self.own = queries.column("exclude_id").combine_chunks()
        self.q = _matrix(queries.column("embedding"))
        self.single = self.q.astype(np.float32)
        self.length = np.linalg.norm(self.q, axis=1)
        self.k, self.unique = k, unique
        self.floor = np.full(len(self.q), -np.inf)
        if least is not None:
            self.floor = np.where(np.isnan(least), -np.inf, least - 1 / _SCALE)
        self._kept: pa.Table | None = None
        self._new: list[pa.Table] = []
        self._n_new = 0

    def add(self, ids: pa.Array, vectors: np.ndarray, own: Own | None = None,
            rows: np.ndarray | None = None, cols: np.ndarray | None = None,
            asked: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Compare the queries ``rows`` with the batch's rows ``cols`` (all by default). ``asked``
        tells which queries (rows) want which kinds (columns), and the kind of each row."""
        if not len(self.q) or not len(ids):
            return
        own = own or Own(self.own, ids)
        rows = np.arange(len(self.q)) if rows is None else rows
        cols = np.arange(len(ids)) if cols is None else cols
        if not len(rows) or not len(cols):
            return
        c = vectors[cols]
        single = c.astype(np.float32)
        # Rounding of the factors and of every sum, for the longest vector of the batch.
        unit = (c.shape[1] + 8) * 2.0 ** -24 * np.linalg.norm(c, axis=1).max()
        n, step = len(cols), max(1, _TILE // len(cols))
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            error = unit * self.length[part]
            score = self.single[part] @ single.T
            own.hide(score, part, cols)
            if asked:
                wanted = asked[0][part][:, asked[1]]
                score[~wanted] = -np.inf
            reach = score >= (self.floor[part] - error)[:, None]
            if asked:
                reach &= wanted
            k = self.k * max(1, self.unique)
            if k < n and np.count_nonzero(reach) > 2 * k * len(part):
                kth = np.partition(score, n - k, axis=1)[:, n - k]
                self.floor[part] = np.fmax(self.floor[part], kth - error - 1 / _SCALE)
                reach &= score >= (self.floor[part] - error)[:, None]
            at, col = np.nonzero(reach)
            if len(at):
                self.take(part[at], cols[col], ids, vectors, own)

    def take(self, rows: np.ndarray, cols: np.ndarray, ids: pa.Array, vectors: np.ndarray,
              own: Own) -> None:
        """Score candidates exactly and keep them until there are too many."""
        allowed = ~own.mine(rows, cols)
        rows, cols = rows[allowed], cols[allowed]
        for lo in range(0, len(rows), _EXACT_ROWS):
            r, c = rows[lo:lo + _EXACT_ROWS], cols[lo:lo + _EXACT_ROWS]
            score = np.rint(np.einsum("ij,ij->i", self.q[r], vectors[c]) * _SCALE) / _SCALE
            good = score >= self.floor[r]
            self._new.append(pa.table({"row": r[good], "similarity": score[good],
                                       "pair_id": ids.take(pa.array(c[good]))}))
            self._n_new += int(good.sum())
            if self._n_new > 4 * self.k * len(self.q) + _EXACT_ROWS:
                self._cut()

    def _cut(self) -> None:
        """Keep ``k`` rows of each query; the last of them is what others have to reach."""
        if not self._new:
            return
        kept = pa.concat_tables([t for t in (self._kept, *self._new) if t is not None])
        if self.unique:
            kept = kept.group_by(["row", "pair_id"]).aggregate([("similarity", "max")]).rename_columns(
                {"similarity_max": "similarity"}).select(["row", "similarity", "pair_id"])
        kept = kept.combine_chunks().sort_by([("row", "ascending"), ("similarity", "descending"),
                                              ("pair_id", "ascending")])
        self._new, self._n_new = [], 0
        row = kept.column("row").to_numpy()
        if len(row):
            start = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
            place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
            last = np.flatnonzero(place == self.k - 1)
            floor = kept.column("similarity").to_numpy()[last] - 1 / _SCALE
            self.floor[row[last]] = np.fmax(self.floor[row[last]], floor)
            kept = kept.filter(pa.array(place < self.k))
        self._kept = kept

    def hits(self) -> pa.Table:
        self._cut()
        if self._kept is None:
            return _ARROW_HITS.empty_table()
        kept = self._kept
        return pa.table([self.ids.take(kept.column("row").combine_chunks()),
                         kept.column("pair_id"), kept.column("similarity")],
                        names=_ARROW_HITS.names).cast(_ARROW_HITS)


class Reach:
    """What a score has to reach to be among the ``keep`` highest of each query.

    Every query has places for three times as many scores; when they are full, only the highest are
    kept, found by selection within the query and not by sorting.
    """

    def __init__(self, n: int, keep: int) -> None:
        self.keep = keep
        self.floor = np.full(n, -np.inf, np.float32)
        self._held = np.empty((n, 3 * keep), np.float32)
        self._filled = np.zeros(n, np.int64)

    def add(self, rows: np.ndarray, score: np.ndarray) -> None:
        """The scores of the queries ``rows``, each query at most once."""
        n = score.shape[1]
        reach = score > self.floor[rows][:, None]
        count = np.count_nonzero(reach, axis=1)
        many = np.flatnonzero(count > 2 * self.keep)
        if len(many):
            highest = np.partition(np.where(reach[many], score[many], -np.inf), n - self.keep,
                                   axis=1)[:, n - self.keep:]
            reach[many], count[many] = False, self.keep
        self._settle(rows[self._filled[rows] + count > self._held.shape[1]])
        free = self._filled[rows]
        if len(many):
            self._held[rows[many][:, None], free[many][:, None] + np.arange(self.keep)] = highest
        self._filled[rows] += count
        count[many] = 0
        at, col = np.nonzero(reach)
        place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        self._held[rows[at], free[at] + place] = score[at, col]

    def settle(self) -> np.ndarray:
        """Forget all but the ``keep`` highest; the lowest of them, or minus infinity if fewer."""
        self._settle(np.arange(len(self.floor)))
        return self.floor

    def _settle(self, rows: np.ndarray) -> None:
        rows = rows[self._filled[rows] >= self.keep]
        width = self._held.shape[1]
        step = max(1, _TILE // max(1, width))
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            held = self._held[part]
            held[np.arange(width) >= self._filled[part][:, None]] = -np.inf
            held = np.partition(held, width - self.keep, axis=1)[:, width - self.keep:]
            self._held[part, :self.keep], self._filled[part] = held, self.keep
            # The floor itself is not taken again, so it stays just below.
            below = np.nextafter(held[:, 0], np.float32(-np.inf), dtype=np.float32)
            self.floor[part] = np.maximum(self.floor[part], below)


# --- the stored side -------------------------------------------------------------------

def write_stored(rows: DataFrame) -> list[str]:
    """Write ``rows`` to the shared folder in small row groups and return the files."""
    path = scratch_path(rows.sparkSession, "stored")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows.coalesce(TASKS_PER_CORE * cores).write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    return sorted(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())


def read_stored(files: Sequence[str], rows: int, part: int = 0, parts: int = 1
                ) -> Iterator[pa.RecordBatch]:
    """One of several parts of the stored rows, some row groups of each file, batch by batch."""
    group = 0
    for uri in files:
        system, path = fs.FileSystem.from_uri(
            "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith(
                "file://") else uri)
        with system.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            mine = [g for g in range(file.num_row_groups) if (group + g) % parts == part]
            group += file.num_row_groups
            if mine:
                yield from file.iter_batches(rows, row_groups=mine, use_threads=False)


# --- the queries -----------------------------------------------------------------------

Read = Callable[[Sequence[str]], Iterator[pa.RecordBatch]]


def meet_stored(queries: DataFrame, n_stored: int, work: Callable[[pa.Table, Read], pa.Table],
                read_rows: int = READ_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Hits of ``work(block of queries, read)`` for all blocks of ``queries``, where ``read(files)``
    gives the batches of stored files.

    Few queries meet the ``n_stored`` rows in several parts of the files, one task for each, and a
    query then has hits of every part.
    """
    spark = queries.sparkSession
    ship_package(spark)
    wanted = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    n = queries.count()
    blocks = max(1, math.ceil(n / query_rows), min(math.ceil(n / LEAST_ROWS), wanted))
    parts = max(1, min(math.ceil(wanted / blocks), n_stored // PART_ROWS))
    names = queries.columns
    read_rows = max(1, min(read_rows, READ_ROWS))
    dealt = queries.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Ranges of equal size; a task has the queries of one part, at the borders of two.
    dealt = dealt.repartitionByRange(blocks * parts, "__part", F.xxhash64("query_id"))

    def answer(block: pa.Table) -> Iterator[pa.RecordBatch]:
        number = block.column("__part").to_numpy()
        for part in np.unique(number):
            asked = block.filter(pa.array(number == part)).select(names)
            found = work(asked, partial(read_stored, rows=read_rows, part=int(part), parts=parts))
            yield from found.cast(_ARROW_HITS).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, query_rows):
                piece = batch.slice(lo, query_rows)
                if n_held and n_held + piece.num_rows > 2 * query_rows:
                    yield from answer(pa.Table.from_batches(held))
                    held, n_held = [], 0
                held.append(piece)
                n_held += piece.num_rows
        if n_held:
            yield from answer(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, HITS)
