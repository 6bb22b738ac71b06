"""Hard negatives from zone maps over Hilbert-ordered blocks.

Vectors become integers and are written in the order of label and place on a Hilbert curve, as
Parquet blocks of a fixed number of vectors of one label. Each block carries the least and greatest
value of every dimension, its zone map. An anchor's product with anything in a block lies between
two sums that interval arithmetic reads off the zone map, so the maps alone (a narrow column of the
file) say which blocks can reach into the windows of scores that an anchor asks for; the others are
not read.

A search runs twice over the maps. First every anchor reads the one block with the highest bound,
which yields a score that its list must at least reach, then all blocks that can reach it. Anchors
and blocks meet in tiles of bounded size, each a task of its own, which keeps the best of every
window and nothing else. Results are exact whatever the order of blocks; if the vectors have no
structure that boxes catch, most blocks are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from replyloom.llm.common import Scratch
from replyloom.llm.hilbert import hilbert_keys
from replyloom.llm.vectors import common_length, finite_rows, matrices
from replyloom.operators.keys import top_per_key

#: Entry x becomes floor(256 x); entries beyond this many steps count as this many.
GRID = 256
MOST_STEPS = 1 << 26
#: Vectors of a block.
BLOCK_ROWS = 256
#: Bits a dimension on the curve, and dimensions used for it, the most spread first.
CURVE_BITS = 4
CURVE_DIMS = 64
#: Rows whose anchors form one group.
GROUP_ROWS = 1 << 19
#: Blocks that one tile reads, at most; smaller tables are dealt to about 64 tiles.
TILE_BLOCKS = 1024
#: Candidates a tile holds before it cuts them to the best of each window.
HELD = 1 << 20


def on_grid(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(GRID * vectors), -MOST_STEPS, MOST_STEPS).astype(np.int32)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers, through doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each anchor with any point of each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return (exact_products(up, low) + exact_products(down, high),
            exact_products(up, high) + exact_products(down, low))


@dataclass(frozen=True)
class Curve:
    """Which dimensions the curve runs through, and the range of each."""

    dims: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def keys(self, vectors: np.ndarray) -> list[bytes]:
        width = np.where(self.high > self.low, self.high - self.low, 1.0)
        share = (vectors[:, self.dims] - self.low) / width
        cells = np.clip((share * (1 << CURVE_BITS)).astype(np.int64), 0, (1 << CURVE_BITS) - 1)
        return hilbert_keys(cells, CURVE_BITS)


def _ranges(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for _, vectors in matrices(batches, "vector", width):
        x = on_grid(vectors).astype(float)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0)),
             pa.array(x.sum(axis=0)), pa.array((x * x).sum(axis=0)),
             pa.array([float(len(x))] * width)],
            names=["dim", "low", "high", "first", "second", "n"])


def fit_curve(vectors: DataFrame, width: int) -> Curve:
    """One pass over the vectors; one row a dimension reaches the driver."""
    found = vectors.select("vector").mapInArrow(
        lambda it: _ranges(it, width),
        "dim int, low double, high double, first double, second double, n double"
    ).groupBy("dim").agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        (F.sum("second") / F.sum("n") - F.pow(F.sum("first") / F.sum("n"), 2)).alias("spread")
    ).orderBy("dim").toPandas()
    dims = np.argsort(-found["spread"].to_numpy(), kind="stable")[:CURVE_DIMS]
    return Curve(dims, found["low"].to_numpy()[dims], found["high"].to_numpy()[dims])


def _placed(batches: Iterable[pa.RecordBatch], width: int,
            curve: Curve) -> Iterator[pa.RecordBatch]:
    for part, vectors in matrices(batches, "vector", width):
        x = on_grid(vectors)
        columns = [part.column(part.schema.get_field_index(c)) for c in ("id", "label")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(curve.keys(x), pa.binary()),
             pa.array([row.tobytes() for row in x], pa.binary())],
            names=["id", "label", "place", "vector"])


_BLOCK = "label long, n int, ids binary, low binary, high binary, vectors binary"


def _blocks(batches: Iterable[pa.RecordBatch], width: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one label as blocks."""
    label, ids, vectors = None, [], []

    def block() -> dict:
        x = np.frombuffer(b"".join(vectors), np.int32).reshape(len(vectors), width)
        return {"label": label, "n": len(ids), "ids": np.array(ids, np.int64).tobytes(),
                "low": x.min(axis=0).tobytes(), "high": x.max(axis=0).tobytes(),
                "vectors": x.tobytes()}

    schema = pa.schema([("label", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()),
                        ("low", pa.binary()), ("high", pa.binary()), ("vectors", pa.binary())])
    for batch in batches:
        done = []
        for row_id, row_label, vector in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if ids and (row_label != label or len(ids) == rows):
                done.append(block())
                ids, vectors = [], []
            label = row_label
            ids.append(row_id)
            vectors.append(vector)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if ids:
        yield pa.RecordBatch.from_pylist([block()], schema=schema)


def write_blocks(scratch: Scratch, vectors: DataFrame, width: int, block_rows: int) -> DataFrame:
    """The blocks of ``id, label, vector`` rows, numbered from 0 along label and curve."""
    curve = fit_curve(vectors, width)
    ordered = vectors.mapInArrow(
        lambda it: _placed(it, width, curve), "id long, label long, place binary, vector binary"
    ).repartitionByRange("label", "place", "id").sortWithinPartitions("label", "place", "id")
    blocks = scratch.write(
        ordered.select("id", "label", "vector").mapInArrow(
            lambda it: _blocks(it, width, block_rows), _BLOCK)
        .withColumn("at", F.monotonically_increasing_id()), "blocks")
    parts = blocks.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    before = np.cumsum([0] + [row["count"] for row in parts]).tolist()
    starts = blocks.sparkSession.createDataFrame(  # one row per written partition
        [(row["part"], n) for row, n in zip(parts, before)], "part long, start long")
    return blocks.withColumn("part", F.shiftright("at", 33)).join(
        F.broadcast(starts), "part").withColumn(
        "block", F.col("start") + F.col("at") - F.shiftleft("part", 33)).drop(
        "part", "start", "at")


def _matrix(cells: Iterable[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.int32).reshape(-1, width)


class _Asked:
    """The anchors of one group: vectors, labels and the score windows each of them asks for."""

    def __init__(self, frame: pd.DataFrame, width: int) -> None:
        frame = frame.sort_values("anchor")
        self.anchor = frame["anchor"].to_numpy()
        self.ids = frame["anchor_id"].to_numpy()
        self.labels = frame["label"].to_numpy()
        self.vectors = _matrix(frame["vector"], width)
        sizes = frame["lows"].map(len).to_numpy()
        most = int(sizes.max())
        # Windows that an anchor has not are empty: above everything, below everything.
        self.lows = np.full((len(frame), most), np.iinfo(np.int64).max)
        self.highs = np.full((len(frame), most), np.iinfo(np.int64).min)
        for i, (lows, highs) in enumerate(zip(frame["lows"], frame["highs"])):
            self.lows[i, :len(lows)] = lows
            self.highs[i, :len(highs)] = highs

    def wanted(self, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool
               ) -> tuple[np.ndarray, np.ndarray]:
        """Which blocks can hold a score of a window, and the highest score each can have."""
        least, most = score_bounds(self.vectors, low, high)
        fits = (self.labels[:, None] == labels[None, :]) == same
        reach = np.zeros(fits.shape, bool)
        for w in range(self.lows.shape[1]):
            reach |= (most >= self.lows[:, w, None]) & (least <= self.highs[:, w, None])
        return fits & reach, most


class _Best:
    """Running best ``k`` of every window of a group of anchors."""

    def __init__(self, asked: _Asked, k: int) -> None:
        self.asked, self.k = asked, k
        self.lows = asked.lows.copy()  # rise as lists fill
        empty = np.empty(0, np.int64)
        self.rows, self.scores, self.ids = empty, empty, empty
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, block_ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> None:
        asked = self.asked
        scores = exact_products(asked.vectors[rows], vectors)
        inside = ((scores >= self.lows[rows].min(axis=1)[:, None])
                  & (scores <= asked.highs[rows].max(axis=1)[:, None])
                  & (block_ids[None, :] != asked.ids[rows][:, None]))
        i, j = np.nonzero(inside)
        self.parts.append((rows[i], scores[i, j], block_ids[j]))
        self.held += len(i)
        if self.held > HELD:
            self.cut()

    def _sorted(self) -> None:
        parts = [(self.rows, self.scores, self.ids), *self.parts]
        self.parts, self.held = [], 0
        rows, scores, ids = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((ids, -scores, rows))
        self.rows, self.scores, self.ids = rows[order], scores[order], ids[order]

    def _picks(self) -> Iterator[tuple[int, int, int, int]]:
        """Row, window and range of the sorted candidates that are its best."""
        starts = np.searchsorted(self.rows, np.arange(len(self.asked.ids) + 1))
        for row in range(len(self.asked.ids)):
            a, b = starts[row], starts[row + 1]
            if a == b:
                continue
            falling = -self.scores[a:b]
            firsts = np.searchsorted(falling, -self.asked.highs[row], side="left")
            lasts = np.searchsorted(falling, -self.asked.lows[row], side="right")
            for w, (first, last) in enumerate(zip(firsts, np.minimum(lasts, firsts + self.k))):
                if first < last:
                    yield row, w, a + first, a + last

    def cut(self) -> None:
        self._sorted()
        keep = np.zeros(len(self.rows), bool)
        for row, w, a, b in self._picks():
            keep[a:b] = True
            if b - a == self.k:
                self.lows[row, w] = max(self.lows[row, w], self.scores[b - 1])
        self.rows, self.scores, self.ids = self.rows[keep], self.scores[keep], self.ids[keep]

    def least(self) -> np.ndarray:
        """What the windows' lists have to reach at least, after all that was added."""
        self.cut()
        return self.lows

    def lists(self) -> pd.DataFrame:
        self._sorted()
        out = [(self.asked.anchor[row], w, self.scores[i], self.ids[i])
               for row, w, a, b in self._picks() for i in range(a, b)]
        return pd.DataFrame(out, columns=["anchor", "window", "score", "id"])


_HITS = "anchor long, window int, score long, id long"
_ANCHOR = "anchor long, anchor_id long, label long, vector binary, lows array<long>, highs array<long>"


def _cogrouped(anchors: DataFrame, blocks: DataFrame) -> PandasCogroupedOps:
    """Both sides by tile; new columns on one side, as they may come from the same table."""
    blocks = blocks.toDF(*blocks.columns)
    return anchors.groupBy("group", "tile").cogroup(blocks.groupBy("group", "tile"))


class Miner:
    """Searches over the blocks of one table."""

    def __init__(self, scratch: Scratch, blocks: DataFrame, width: int, block_rows: int) -> None:
        self.scratch, self.blocks, self.width = scratch, blocks, width
        count = blocks.count()
        self.group_blocks = max(1, GROUP_ROWS // block_rows)
        self.tile_blocks = min(TILE_BLOCKS, max(4, count // 64))
        self.tiles = -(-count // self.tile_blocks)
        self.groups = -(-count // self.group_blocks)
        self.block_rows = block_rows

    def tile(self) -> Column:
        return (F.col("block") / self.tile_blocks).cast("long")

    def group_of(self) -> Column:
        """An anchor's group: anchors are numbered as the rows of their blocks are."""
        return (F.col("anchor") / (self.group_blocks * self.block_rows)).cast("long")

    def _met(self, anchors: DataFrame, blocks: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """``fn(anchors, blocks)`` on every tile; ``blocks`` have ``group`` and ``tile``."""
        dealt = anchors.withColumn("group", self.group_of()).withColumn(
            "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.tiles - 1).cast("long"))))
        return _cogrouped(dealt, blocks).applyInPandas(
            lambda a, b: fn(a, b) if len(a) and len(b) else pd.DataFrame(
                {f.split()[0]: [] for f in schema.split(", ")}), schema)

    def zones(self) -> DataFrame:
        """The maps for every group of anchors; no vectors are read."""
        return self.blocks.select("block", "label", "low", "high").withColumn(
            "tile", self.tile()).withColumn("group", F.explode(
                F.sequence(F.lit(0).cast("long"), F.lit(self.groups - 1).cast("long"))))

    def seeds(self, anchors: DataFrame, same: bool) -> DataFrame:
        """For each anchor the block that can hold the highest score of its windows."""
        width = self.width

        def highest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            asked, blocks = _Asked(a, width), b["block"].to_numpy()
            wanted, most = asked.wanted(b["label"].to_numpy(), _matrix(b["low"], width),
                                        _matrix(b["high"], width), same)
            at = np.argmax(np.where(wanted, most, np.iinfo(np.int64).min), axis=1)
            row = np.flatnonzero(wanted.any(axis=1))
            return pd.DataFrame({"anchor": asked.anchor[row], "bound": most[row, at[row]],
                                 "block": blocks[at[row]]})

        found = self._met(anchors, self.zones(), highest, "anchor long, bound long, block long")
        return found.groupBy("anchor").agg(
            F.max(F.struct("bound", "block")).getField("block").alias("block"))

    def needed(self, anchors: DataFrame, same: bool) -> DataFrame:
        """``group, block`` for every block that the windows of some anchor must read."""
        width = self.width

        def reached(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            wanted, _ = _Asked(a, width).wanted(b["label"].to_numpy(), _matrix(b["low"], width),
                                                _matrix(b["high"], width), same)
            return b.loc[wanted.any(axis=0), ["group", "block"]]

        return self._met(anchors, self.zones(), reached, "group long, block long")

    def raised(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """``anchors`` with windows from the score that their seed block already offers."""
        width = self.width
        seeds = self.scratch.write(self.seeds(anchors, same), "seeds")
        with_block = anchors.join(seeds, "anchor")

        def offered(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            asked = _Asked(a, width)
            best = _Best(asked, k)
            block_of = dict(zip(a["anchor"], a["block"]))
            mine = np.array([block_of[x] for x in asked.anchor])
            for row in b.itertuples():
                rows = np.flatnonzero(mine == row.block)
                if len(rows):
                    best.add(np.frombuffer(row.ids, np.int64), _matrix([row.vectors], width), rows)
            least = best.least()
            sizes = dict(zip(a["anchor"], a["lows"].map(len)))
            return pd.DataFrame({"anchor": asked.anchor, "least": [
                low[:sizes[x]].tolist() for x, low in zip(asked.anchor, least)]})

        # Only the tile of its own block meets an anchor here.
        dealt = with_block.withColumn("group", self.group_of()).withColumn("tile", self.tile())
        read = self.blocks.join(
            dealt.select("group", "block").distinct(), "block").withColumn("tile", self.tile())
        least = _cogrouped(dealt, read).applyInPandas(
            offered, "anchor long, least array<long>")
        return self.scratch.write(
            anchors.join(least, "anchor", "left").withColumn(
                "lows", F.coalesce("least", "lows")).drop("least"), "raised")

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """The first ``k`` rows of every window: ``anchor, window, score, id`` and ``rank``.

        ``same`` asks for rows of the anchor's label, else for rows of other labels. Rows with the
        anchor's id are never among them.
        """
        width = self.width
        anchors = self.raised(anchors, same, k)
        needed = self.scratch.write(self.needed(anchors, same), "needed")
        read = self.blocks.join(needed, "block").withColumn("tile", self.tile())

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            asked = _Asked(a, width)
            wanted, most = asked.wanted(b["label"].to_numpy(), _matrix(b["low"], width),
                                        _matrix(b["high"], width), same)
            found = _Best(asked, k)
            # Blocks with the highest bounds first: they raise what the others have to reach.
            for at in np.argsort(-np.where(wanted, most, np.iinfo(np.int64).min).max(axis=0)):
                rows = np.flatnonzero(
                    wanted[:, at] & (most[:, at] >= found.lows.min(axis=1)))
                if len(rows):
                    found.add(np.frombuffer(b["ids"].iat[at], np.int64),
                              _matrix([b["vectors"].iat[at]], width), rows)
            return found.lists()

        hits = self._met(anchors, read, best, _HITS)
        return self.scratch.write(
            top_per_key(hits, ["anchor", "window"], [F.desc("score"), F.asc("id")], k, "rank"),
            "hits")


def _anchors(batches: Iterable[pa.RecordBatch], width: int, rows: int,
             every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            x = np.frombuffer(row["vectors"], np.int32).reshape(-1, width)
            out += [(row["block"] * rows + int(i), int(ids[i]), row["label"], x[i].tobytes())
                    for i in np.flatnonzero(ids % every == 0)]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["anchor", "anchor_id", "label", "vector"])


def mine_hard_negatives(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str = "label", every: int = 100, positives: int = 5,
                        negatives: int = 10, lowest: int = 30, highest: int = 90,
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Entries x count as floor(256 x), scores are integer inner products, higher ones come first and
    of equal ones the smaller id. Anchors are the rows whose id is divisible by ``every``. Each has
    its first ``positives`` rows of the same label, and for each of these the first ``negatives``
    rows of other labels whose score is ``lowest`` to ``highest`` percent of the positive's.

    Rows with a null id, label or vector, with a null or non-finite entry, or with another than the
    most frequent length take no part; ids and labels are integers. Rows that share an id are rows
    of their own, but no partners of each other. An anchor without positives, or a positive without
    negatives in the window (always, if its score is negative), gives no rows; nor does an empty
    table. Entries beyond 2**26 steps count as 2**26. Other columns are not read.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    try:
        rows = finite_rows(table.select(
            F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
            F.col(vector_col).alias("vector")), "vector").dropna()
        width = common_length(rows, "vector")
        if not width:
            scratch.drop()
            return spark.createDataFrame(
                [], "anchor_id long, positive_id long, rank int, negative_id long, "
                    "positive_score long, negative_score long")
        blocks = write_blocks(scratch, rows.filter(F.size("vector") == width), width, block_rows)
        return scratch.finish(_mined(Miner(scratch, blocks, width, block_rows), every, positives,
                                     negatives, lowest, highest))
    except BaseException:
        scratch.drop()
        raise


def _share(score: Column, percent: int, up: bool) -> Column:
    """``percent`` of an integer score, rounded up or down without leaving the integers."""
    product = score.cast("decimal(38,0)") * F.lit(percent).cast("decimal(3,0)")
    rounded = (F.ceil if up else F.floor)(product / F.lit(100).cast("decimal(3,0)"))
    return rounded.cast("long")


def _mined(miner: Miner, every: int, positives: int, negatives: int, lowest: int,
           highest: int) -> DataFrame:
    width, block_rows = miner.width, miner.block_rows
    least, most = np.iinfo(np.int64).min // 2, np.iinfo(np.int64).max // 2
    anchors = miner.scratch.write(
        miner.blocks.select("block", "label", "ids", "vectors").mapInArrow(
            lambda it: _anchors(it, width, block_rows, every),
            "anchor long, anchor_id long, label long, vector binary")
        .withColumn("lows", F.array(F.lit(least))).withColumn("highs", F.array(F.lit(most))),
        "anchors")
    found = miner.search(anchors, True, positives).select(
        "anchor", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"))
    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(
        F.struct("positive_rank", "positive_score"))).alias("own")).select(
        "anchor",
        F.transform("own", lambda p: _share(p["positive_score"], lowest, up=True)).alias("lows"),
        F.transform("own", lambda p: _share(p["positive_score"], highest, up=False))
        .alias("highs"))
    asked = miner.scratch.write(
        anchors.drop("lows", "highs").join(windows, "anchor"), "windows")
    hits = miner.search(asked, False, negatives).select(
        "anchor", (F.col("window") + 1).alias("positive_rank"), F.col("rank").cast("int"),
        F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (hits.join(found, ["anchor", "positive_rank"])
            .join(anchors.select("anchor", "anchor_id"), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score"))
