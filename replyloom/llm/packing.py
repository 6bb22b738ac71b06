"""Conflict-constrained best-fit packing.

Bins have a fixed number of words. They are kept in the order of their residual space, and each
carries bitmaps of the sources and duplicate clusters it holds. A piece goes to the tightest bin
that is compatible: the search starts at the smallest residual that fits and moves to its
successors until a bin conflicts in neither bitmap; otherwise a new bin is opened. Pieces come
largest first.

Documents are dealt by a hash to groups of bounded size that are packed on their own, so no task
grows with the corpus, a hot source or a large cluster, and only the last bins of a group stay
half full. Texts are measured in place and never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import Scratch, count_words

CAPACITY_WORDS = 4096
GROUP_PIECES = 4096
#: Pieces of one source that a bin may hold.
MAX_PER_SOURCE = 4
_BIN_BITS = 20


class Packer:
    """Bins of one group. Bitmaps are integers; bit ``i`` stands for the ``i``-th key seen."""

    def __init__(self, capacity: int, max_per_source: int) -> None:
        self.capacity = capacity
        self.max_per_source = max_per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.clusters: list[int] = []
        self.planes: list[list[int]] = []  # plane j: sources that the bin holds over j times
        self.bits: dict[tuple, int] = {}

    def _bit(self, kind: str, key: object) -> int:
        return 1 << self.bits.setdefault((kind, key), len(self.bits))

    def place(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """Bin and offset of the next piece."""
        source_bit, cluster_bit = self._bit("source", source), self._bit("cluster", cluster)
        top = self.max_per_source - 1
        for at in range(bisect_left(self.order, (size, -1)), len(self.order)):
            residual, number = self.order[at]
            if not (self.clusters[number] & cluster_bit or self.planes[number][top] & source_bit):
                del self.order[at]
                break
        else:
            residual, number = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.planes.append([0] * self.max_per_source)
        self.clusters[number] |= cluster_bit
        planes = self.planes[number]
        planes[next(j for j in range(self.max_per_source) if not planes[j] & source_bit)] |= source_bit
        if residual > size:
            insort(self.order, (residual - size, number))
        return number, self.capacity - residual


def _pack_group(pieces: pd.DataFrame, id_col: str, capacity: int,
                max_per_source: int) -> pd.DataFrame:
    pieces = pieces.sort_values(["n_words", "text_key", "piece", id_col],
                                ascending=[False, True, True, True], kind="stable",
                                ignore_index=True)
    packer = Packer(capacity, max_per_source)
    placed = [packer.place(n, None if pd.isna(s) else s, c) for n, s, c in
              zip(pieces["n_words"].tolist(), pieces["source_key"], pieces["cluster_key"])]
    pieces["bin_id"] = [(g << _BIN_BITS) + b for g, (b, _) in zip(pieces["grp"].tolist(), placed)]
    pieces["bin_offset"] = [o for _, o in placed]
    return pieces[[id_col, "piece", "first_word", "n_words", "bin_id", "bin_offset"]]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                   text_col: str = "text", cluster_col: str | None = None,
                   capacity: int = CAPACITY_WORDS, max_per_source: int = MAX_PER_SOURCE,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: the id, ``piece``, ``first_word``, ``n_words``, ``bin_id``, ``bin_offset``.

    A document of more than ``capacity`` words is cut into pieces of that size and a rest. No two
    pieces of one cluster share a bin, hence no two pieces of one document; a bin holds at most
    ``max_per_source`` pieces of a source. The cluster is ``cluster_col``, or else equality of the
    text lower-cased in A-Z. Null sources are one source; a null cluster conflicts with null
    clusters. A document without words takes no space: one row with null bin and offset. Repeated
    rows are packed apart. Ids are integers and may be null.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    keep = [id_col, source_col] + ([cluster_col] if cluster_col else [])
    sized = scratch.write(
        count_words(docs, keep, text_col, with_digest=cluster_col is None)
        .select(id_col, "n_words", "text_key", F.col(source_col).alias("source_key"),
                F.coalesce(F.xxhash64(cluster_col or "digest"), F.lit(0)).alias("cluster_key")),
        "sized")
    pieces = sized.filter("n_words > 0").select(
        "*", F.explode(F.expr(f"sequence(0, cast((n_words - 1) div {capacity} as int))"))
        .alias("piece")).withColumn("first_word", F.col("piece").cast("long") * capacity)
    pieces = pieces.withColumn("n_words", F.least(F.lit(capacity), F.col("n_words") - F.col("first_word")))
    n_groups = max(1, -(-pieces.count() // group_pieces))
    # A document repeated without end is spread as well: its rows differ in their place alone.
    pieces = pieces.withColumn("grp", F.pmod(
        F.xxhash64(id_col, "text_key", "piece", F.spark_partition_id()), F.lit(n_groups)))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, piece int, first_word long, n_words long, bin_id long, "
              "bin_offset long")
    packed = pieces.groupBy("grp").applyInPandas(
        lambda f: _pack_group(f, id_col, capacity, max_per_source), schema)
    empty = sized.filter("n_words = 0").select(
        id_col, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_word"), "n_words",
        F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    return scratch.finish(packed.unionByName(empty))
