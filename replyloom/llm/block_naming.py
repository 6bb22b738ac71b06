"""Exact dedup by deterministic block naming.

Every text, lower-cased in A-Z, is cut into blocks of a fixed number of bytes. Equal blocks get
equal integers: the distinct blocks are grouped, sorted and numbered. Then neighbouring names are
paired and every distinct pair is numbered in turn, level by level, until a document has a single
name. Together with the number of blocks that name is equal for two documents if, and only if,
their texts are equal.

Blocks travel once, after Spark's map-side grouping has merged the copies inside each task, so a
text that a third of all rows share is sent once per task. All later steps move integers. A hash
is the grouping key; a key that covers two different blocks is noticed while grouping, and the
pass is then repeated with another seed, so no collision survives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replyloom.llm.common import Scratch, byte_slices, field, frame, signed
from replyloom.operators.keys import lookup_join

BLOCK_BYTES = 8192


def _blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)] or [b""]


def _key(block: bytes, seed: int) -> int:
    return signed(xxhash.xxh3_64_intdigest(block, seed))


def _rows_of(batches: Iterable[pa.RecordBatch], id_col: str, size: int,
             seed: int) -> Iterator[pa.RecordBatch]:
    for part, texts in byte_slices(batches):
        low = [t.lower() for t in texts]  # bytes.lower() changes A-Z alone
        yield frame(part, ["row_id", id_col], {
            "text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in low], pa.string()),
            "keys": pa.array([[_key(b, seed) for b in _blocks(t, size)] for t in low],
                             pa.list_(pa.int64()))})


def _blocks_of(batches: Iterable[pa.RecordBatch], size: int,
               seed: int) -> Iterator[pa.RecordBatch]:
    for _, texts in byte_slices(batches):
        blocks = [b for t in texts for b in _blocks(t.lower(), size)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_key(b, seed) for b in blocks], pa.int64()), pa.array(blocks, pa.binary())],
            names=["key", "block"])


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Number distinct rows. Written at once by the caller, so that a number never changes."""
    return distinct.sortWithinPartitions(*order).withColumn(
        "name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``row_id``, the id, ``text_sha256``, ``n_blocks`` and ``name``.

    Two rows have equal (``n_blocks``, ``name``) exactly when their texts are equal after
    lower-casing A-Z. Null counts as the empty text, which is one empty block. Other columns of
    ``docs`` are not read, so their names cannot clash. Repeated rows stay repeated.
    """
    scratch = Scratch(docs.sparkSession, "block-naming")
    return scratch.finish(_named(scratch, docs, id_col, text_col, block_bytes))


def _named(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str,
           block_bytes: int) -> DataFrame:
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    seed = 0
    while True:
        names = scratch.write(_numbered(
            texts.select("text")
            .mapInArrow(lambda it, s=seed: _blocks_of(it, block_bytes, s), "key long, block binary")
            .groupBy("key").agg(F.collect_set("block").alias("forms"))
            .select("key", F.size("forms").alias("n_forms")), ["key"]), "names")
        if not names.filter("n_forms > 1").limit(1).count():
            break
        seed += 1
    rows = scratch.write(
        texts.withColumn("row_id", F.monotonically_increasing_id())
        .mapInArrow(lambda it: _rows_of(it, id_col, block_bytes, seed),
                    f"row_id long, {field(texts, id_col)}, text_sha256 string, keys array<long>"),
        "rows")
    most = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    level = (rows.select("row_id", F.posexplode("keys").alias("pos", "key"))
             .join(names.select("key", "name"), "key").select("row_id", "pos", "name"))
    single = rows.select("row_id", F.size("keys").alias("n_blocks"))
    done = []
    width = 1
    while True:
        # After k levels a row of n blocks has ceil(n / 2**k) names left.
        level = scratch.write(level, "level")
        finished = single.filter((F.col("n_blocks") <= width) & (F.col("n_blocks") > width // 2))
        done.append(level.filter("pos = 0").join(finished, "row_id"))
        if width >= most:
            break
        open_rows = single.filter(F.col("n_blocks") > width).select("row_id")
        pairs = scratch.write(
            level.join(open_rows, "row_id", "left_semi")
            .groupBy("row_id", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left_name"),
                 F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1))
                 .alias("right_name")), "pairs")
        numbered = scratch.write(
            _numbered(pairs.select("left_name", "right_name").distinct(),
                      ["left_name", "right_name"]), "pair-names")
        level = (pairs.join(numbered, ["left_name", "right_name"])
                 .select("row_id", "pos", "name"))
        width *= 2
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    return rows.select("row_id", id_col, "text_sha256").join(
        named.select("row_id", "n_blocks", "name"), "row_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of equal texts: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Every input row comes back. The row with the largest id of its group stays; a null id is the
    smallest. Of rows repeated with the same id and text exactly one stays. An empty table gives
    an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    judged = _judged(scratch, _named(scratch, docs, id_col, text_col, block_bytes), id_col)
    return scratch.finish(judged.select(id_col, "keep_id", "group_size", "kept", "text_sha256"))


def _judged(scratch: Scratch, named: DataFrame, id_col: str) -> DataFrame:
    """Named rows with ``keep_id``, ``group_size`` and ``kept``."""
    named = scratch.write(named.withColumn("identity", F.struct("n_blocks", "name")), "named")
    groups = named.groupBy(F.col("identity").alias("group")).agg(
        F.count("*").alias("group_size"),
        F.max(F.struct(F.col(id_col).alias("id"), "row_id")).alias("best"))
    # A group may hold a third of all rows: a join that AQE can split.
    return lookup_join(named, groups, "identity", "group").select(
        "row_id", id_col, F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The row with the largest id stays, as in :func:`exact_dedup`; null text counts as empty and a
    null id is the smallest. Rows are told apart by id and text, so ids may repeat; of rows that
    repeat both one stays. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "drop-copies")
    judged = _judged(scratch, _named(scratch, docs, id_col, text_col, block_bytes), id_col)
    # One row for each id and text: what is stored is narrow, whatever the texts.
    known = scratch.finish(judged.groupBy(
        F.col(id_col).alias("__id"), F.col("text_sha256").alias("__text")).agg(
        F.count("*").alias("rows"), F.max("kept").alias("stays")))
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase)
    keyed = docs.withColumn("__sha", F.sha2(low, 256))
    gone = known.filter(~F.col("stays"))
    kept = keyed.join(gone, keyed[id_col].eqNullSafe(gone["__id"])
                      & (keyed["__sha"] == gone["__text"]), "left_anti")
    if known.filter("stays AND rows > 1").limit(1).count():
        # Rows that repeat id and text have to be told apart.
        first = Window.partitionBy(id_col, "__sha").orderBy("__sha")
        kept = kept.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1")
    return kept.select(*docs.columns)
