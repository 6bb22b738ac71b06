"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equal size. Slot ``k`` stands at the golden-ratio point
``frac((k + 1) * phi)``; the sources' cumulative targets cut the unit interval, and the source
whose piece holds the point fills the slot. So every stretch of the mix has nearly the target
shares. The slots of a source are ranked; rank ``r`` takes block ``r mod n_blocks`` of the source's
shuffled text, once more round after each pass. The last slot of a source is cut at its target.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from replyloom.llm.common import Scratch, byte_slices, count_words, frame, signed
from replyloom.session import ship_package

#: 2**64 / golden ratio, odd: multiples of it modulo 2**64 are the golden-ratio points.
GOLDEN = 0x9E3779B97F4A7C15
BLOCK_WORDS = 256
#: Slots that are ranked together in one task.
CHUNK_SLOTS = 1 << 16
#: Documents of a source whose offsets one task adds up.
BUCKET_DOCS = 20_000
#: More sources than this are refused: their totals are read by the driver.
MAX_SOURCES = 100_000
MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class SourceShare:
    """Of one source: its words, its target in words and the whole words the mix takes."""

    source: str | None
    size: int
    target: float
    words: int


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float,
              max_repeats: float = MAX_REPEATS) -> list[float]:
    """Split ``total`` by weight; none gets over ``max_repeats`` times its size, the excess is
    split among the others in turn."""
    target = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > max_repeats * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(max_repeats * sizes[i])
        left -= sum(target[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


def _shares(counted: DataFrame, source_col: str, weights: Sequence[float],
            max_repeats: int) -> list[SourceShare]:
    rows = (counted.groupBy(source_col).agg(F.sum("n_words").alias("size"))
            .limit(MAX_SOURCES + 1).collect())
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix groups of sources instead")
    # Python orders strings by code point; null comes last.
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r["size"]) for r in rows]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(rows))], sum(sizes),
                        max_repeats)
    return [SourceShare(r[0], size, target, min(round(target), max_repeats * size))
            for r, size, target in zip(rows, sizes, targets)]


def _slots(scratch: Scratch, shares: list[SourceShare], block_words: int) -> DataFrame:
    """``slot, source_ix, rank`` of the whole schedule."""
    spark = scratch.spark
    words = np.array([s.words for s in shares], np.float64)
    n_slots = -(-sum(s.words for s in shares) // block_words)
    ends = np.minimum(np.cumsum(words) / max(words.sum(), 1.0) * 2.0 ** 64, 2.0 ** 64 - 2048)
    ends = ends.astype(np.uint64)

    def pointed(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            slot = f["id"].to_numpy(np.int64)
            points = (slot.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
            at = np.minimum(np.searchsorted(ends, points, side="right"), len(ends) - 1)
            yield pd.DataFrame({"slot": slot, "source_ix": at.astype(np.int32)})

    drawn = spark.range(n_slots).mapInPandas(pointed, "slot long, source_ix int").withColumn(
        "chunk", F.expr(f"slot div {CHUNK_SLOTS}"))
    drawn = scratch.write(drawn, "slots")
    per_chunk = drawn.groupBy("chunk", "source_ix").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_ix").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = per_chunk.select("chunk", "source_ix",
                               F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("chunk", "source_ix").orderBy("slot")
    ranked = (drawn.withColumn("r", F.row_number().over(inside) - 1)
              .join(offsets, ["chunk", "source_ix"])
              .select("slot", "source_ix", (F.col("before") + F.col("r")).alias("rank")))
    have = {r[0]: r[1] for r in per_chunk.groupBy("source_ix").agg(F.sum("n")).collect()}
    closing, end = [], n_slots
    for ix, share in enumerate(shares):
        need = _ranks_needed(share, block_words)
        if need > have.get(ix, 0):
            closing.append((ix, have.get(ix, 0), need - 1, end))
            end += need - have.get(ix, 0)
    if closing:  # a source that the points left short of its target, by a few slots
        tail = spark.createDataFrame(closing, "source_ix int, first long, last long, at long")
        ranked = ranked.unionByName(
            tail.select("*", F.explode(F.sequence("first", "last")).alias("rank"))
            .select((F.col("at") + F.col("rank") - F.col("first")).alias("slot"), "source_ix", "rank"))
    return ranked


def _ranks_needed(share: SourceShare, block_words: int) -> int:
    if not share.size:
        return 0
    blocks = -(-share.size // block_words)
    rounds, rest = divmod(share.words, share.size)
    return rounds * blocks + -(-rest // block_words)


def _placed(scratch: Scratch, counted: DataFrame, id_col: str, source_col: str,
            shares: DataFrame) -> DataFrame:
    """Every row with the place where it starts in its source's shuffled text."""
    n_docs = counted.count()
    bits = max(0, (max(1, n_docs // BUCKET_DOCS) - 1).bit_length())
    rows = counted.join(F.broadcast(shares), counted[source_col].eqNullSafe(shares["share_source"]))
    rows = rows.withColumn("at", F.xxhash64(id_col, "text_key")).withColumn(
        "bucket", F.shiftrightunsigned("at", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = rows.groupBy("source_ix", "bucket").agg(F.sum("n_words").alias("w"))
    earlier = Window.partitionBy("source_ix").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source_ix").alias("o_ix"), F.col("bucket").alias("o_bucket"),
                          F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_ix", "bucket").orderBy("at", id_col, "text_key").rowsBetween(
        Window.unboundedPreceding, -1)
    return (rows.withColumn("own", F.coalesce(F.sum("n_words").over(inside), F.lit(0)))
            .join(offsets, (F.col("source_ix") == F.col("o_ix"))
                  & (F.col("bucket") == F.col("o_bucket")))
            .select(id_col, source_col, "text_key", "n_words", "source_ix", "source_size",
                    "target", "goal", (F.col("before") + F.col("own")).alias("start"))
            .withColumn("row_id", F.monotonically_increasing_id()))


def _mixed(scratch: Scratch, docs: DataFrame, id_col: str, source_col: str, text_col: str,
           weights: Sequence[float], block_words: int,
           max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their source's figures, and the pieces that the slots take."""
    spark = scratch.spark
    counted = scratch.write(count_words(docs, [id_col, source_col], text_col), "counted")
    shares = _shares(counted, source_col, weights, max_repeats)
    kind = docs.schema[source_col].dataType.simpleString()
    table = spark.createDataFrame(
        [(i, s.source, s.size, s.target, s.words) for i, s in enumerate(shares)],
        f"source_ix int, share_source {kind}, source_size long, target double, goal long")
    placed = scratch.write(_placed(scratch, counted, id_col, source_col, table), "placed")
    pieces = placed.filter("n_words > 0").select(
        "row_id", id_col, "source_ix", "source_size", "goal", "start", "n_words",
        F.explode(F.sequence(F.expr(f"start div {block_words}"),
                             F.expr(f"(start + n_words - 1) div {block_words}"))).alias("block"))
    slots = _slots(scratch, shares, block_words)
    # Words of this source that earlier slots have taken, and where this piece lies in its slot.
    joined = (slots.join(table.select("source_ix", F.col("source_size").alias("s")), "source_ix")
              .withColumn("n_blocks", F.expr(f"(s + {block_words} - 1) div {block_words}"))
              .select("slot", "source_ix", F.expr("rank div n_blocks").alias("epoch"),
                      F.expr("rank % n_blocks").alias("block"))
              .join(pieces, ["source_ix", "block"]))
    begin = F.greatest("start", F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("n_words"), (F.col("block") + 1) * block_words,
                  F.col("goal") - F.col("epoch") * F.col("source_size"))
    taken = joined.select(
        "slot", "epoch", "row_id", id_col, "source_ix", (begin - F.col("start")).alias("first_word"),
        (end - begin).alias("words")).filter("words > 0")
    return placed, taken


def mix_schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                 text_col: str = "text", weights: Sequence[float] = WEIGHTS,
                 block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix in order: ``slot, epoch``, the id, ``first_word`` and ``words`` of each piece."""
    scratch = Scratch(docs.sparkSession, "mixing")
    _, taken = _mixed(scratch, docs, id_col, source_col, text_col, weights, block_words,
                      max_repeats)
    return scratch.finish(taken.select("slot", "epoch", id_col, "first_word", "words"))


def mix_amounts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", weights: Sequence[float] = WEIGHTS,
                block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per row: the id, ``size``, ``source_size``, ``target`` and ``taken``, all in words.

    Sources in code point order, null last, weigh ``weights`` in turn. Their targets share all
    words; none is above ``max_repeats`` times its source, and neither is what is taken of a
    document. A null or blank text has no words and nothing is taken of it. Repeated rows are
    placed one after the other. The order depends on ids and texts alone, so reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    return scratch.finish(_amounts(scratch, docs, id_col, source_col, text_col, weights,
                                   block_words, max_repeats).drop("text_key"))


def _amounts(scratch: Scratch, docs: DataFrame, id_col: str, source_col: str, text_col: str,
             weights: Sequence[float], block_words: int, max_repeats: int) -> DataFrame:
    placed, taken = _mixed(scratch, docs, id_col, source_col, text_col, weights, block_words,
                           max_repeats)
    sums = taken.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return placed.join(sums, "row_id", "left").select(
        id_col, "text_key", F.col("n_words").alias("size"), "source_size", "target",
        F.coalesce("taken", F.lit(0)).alias("taken"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _first_words(text: bytes, n: int) -> bytes:
    """A text up to the end of its ``n``-th word."""
    for k, found in enumerate(_WORD.finditer(text), 1):
        if k == n:
            return text[:found.end()]
    return text


def _copies(batches: Iterable[pa.RecordBatch], names: list[str], text_col: str,
            count_col: str | None) -> Iterator[pa.RecordBatch]:
    for part, texts in byte_slices(batches, text_col):
        taken = part.column(part.schema.get_field_index("__taken")).to_pylist()
        sizes = part.column(part.schema.get_field_index("__size")).to_pylist()
        rows, out = [], []
        for i, (text, n, size) in enumerate(zip(texts, taken, sizes)):
            full, rest = divmod(n, size)
            rows += [i] * (full + bool(rest))
            out += [text] * full + [_first_words(text, rest)] * bool(rest)
        picked = part.take(pa.array(rows, pa.int64()))
        arrays = []
        for name in names:
            column = picked.column(picked.schema.get_field_index(name))
            if name == text_col:
                column = pa.array(out, pa.binary()).cast(pa.string())
            elif name == count_col:
                column = pa.array([len(t.decode()) for t in out], pa.int64()).cast(column.type)
            arrays.append(column)
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                  text_col: str = "text", count_col: str | None = "n_chars",
                  weights: Sequence[float] = WEIGHTS, block_words: int = BLOCK_WORDS,
                  max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed documents, with the columns of ``docs``.

    A document comes as often as the mix takes it; where only a part is taken, that row has the
    first words of its text. Documents of which nothing is taken go. Rows are told apart by id and
    text, so ids may repeat or be null; rows that repeat both share what is taken of them. An empty
    table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    # One row for each id and text: what is stored is narrow, whatever the texts.
    amounts = scratch.finish(
        _amounts(scratch, docs, id_col, source_col, text_col, weights, block_words, max_repeats)
        .groupBy(F.col(id_col).alias("__id"), F.col("text_key").alias("__key"))
        .agg(F.sum("taken").alias("__taken"), F.first("size").alias("__size"),
             F.count("*").alias("__rows")).filter("__taken > 0"))
    ship_package(docs.sparkSession)
    keyed = _with_key(docs, text_col)
    joined = keyed.join(amounts, keyed[id_col].eqNullSafe(amounts["__id"])
                        & (keyed["__text_key"] == amounts["__key"]))
    if amounts.filter("__rows > 1").limit(1).count():
        # Rows that repeat id and text: one of them stands for all.
        one = Window.partitionBy("__id", "__key").orderBy("__text_key")
        joined = joined.withColumn("__rank", F.row_number().over(one)).filter("__rank = 1")
    names = docs.columns
    count = count_col if count_col in names else None
    return joined.select(*names, "__taken", "__size").mapInArrow(
        lambda it: _copies(it, names, text_col, count), docs.schema)


def _with_key(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__text_key``, the hash that :func:`count_words` gives."""
    names = docs.columns

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, text_col):
            yield frame(part, names, {"__text_key": pa.array(
                [signed(xxhash.xxh3_64_intdigest(t)) for t in texts], pa.int64())})

    schema = StructType([*docs.schema.fields, StructField("__text_key", LongType())])
    return docs.mapInArrow(keyed, schema)
