"""Token ids on disk: a concatenated id array and Elias-Fano document boundaries.

A store is a folder of shards in ascending order of the document id. A shard is one file:

    magic 8 bytes; number of ids, of bytes of the doc ids and of bytes of the boundaries, 8 bytes
    each; bytes per id 1; the ids, little-endian, at that width; the document ids, 8 bytes each;
    the Elias-Fano code of the boundaries (where each document ends).

Offsets inside a shard come from the boundaries' ``select``; no table of 64-bit offsets is kept.
The offset of a shard is the sum of the shards before it, which the manifest holds: one row per
shard. Shards hold a bounded number of texts, whatever a partition holds.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replyloom.llm.common import Scratch, byte_slices
from replyloom.llm.elias_fano import EliasFano, encode
from replyloom.llm.files import make_folder, open_folder

MAGIC = b"TOKENEF1"
_HEADER = struct.Struct("<8sQQQB")
END_ID = 1
#: A shard is closed once it holds so many ids.
SHARD_IDS = 4_000_000
#: Chunks of text, and words in them, whose ids a Python worker remembers before it starts afresh.
CHUNK_MEMORY = 150_000
#: White space that the tokenizer drops and that no token spans: blank, tab, line feed, return.
_CUT = bytes.maketrans(b"\t\n\r", b"   ")
#: Letters and then ASCII marks, none of which is an apostrophe or a ``<`` (special tokens).
_PLAIN = re.compile(r"([^\W\d_]+)([!-&(-/:;=-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Remembered(dict):
    """Ids, as bytes, by text. Of two generations of entries the older is forgotten when the newer
    is full, so frequent entries stay."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make
        self.older: dict = {}

    def __missing__(self, text: bytes | str) -> bytes:
        if len(self) >= CHUNK_MEMORY:
            self.older = dict(self)
            self.clear()
        value = self.older.get(text)
        if value is None:
            value = self.make(text)
        self[text] = value
        return value


class ChunkEncoder:
    """Ids of a text as bytes, by way of the ids of its chunks between white space.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of
    its chunks in turn. A chunk of letters with marks behind it falls into these two pieces before
    merging, and the library's model merges each; any other chunk goes through the whole library.
    """

    _shared: dict[tuple[str, int], ChunkEncoder] = {}

    def __init__(self, tokenizer_path: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.code = {1: "B", 2: "H", 4: "I"}[width]
        self.chunks = _Remembered(self._chunk)
        self.pieces = _Remembered(self._piece)
        self.letters = _byte_letters()

    @classmethod
    def shared(cls, tokenizer_path: str, width: int) -> ChunkEncoder:
        """The one of this Python worker; its memory serves all tasks that the worker runs."""
        key = tokenizer_path, width
        if key not in cls._shared:
            cls._shared[key] = cls(tokenizer_path, width)
        return cls._shared[key]

    def _chunk(self, raw: bytes) -> bytes:
        if not raw:
            return b""
        chunk = raw.decode()
        found = _PLAIN.fullmatch(chunk)
        if found:
            word, marks = found.groups()
            low = word.lower()
            # Outside ASCII only letters that lower-casing and composition leave one to one.
            if chunk.isascii() or (
                    word.isalpha() and low.isalpha() and len(low) == len(word) and "\u03c2" not in low
                    and unicodedata.is_normalized("NFC", word)
                    and unicodedata.is_normalized("NFC", low)):
                return self.pieces[low] + self.pieces[marks] if marks else self.pieces[low]
        return self._coded(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join(
            map(self.letters.__getitem__, piece.encode()))
        return self._coded([t.id for t in self.model.tokenize(spelled)])

    def _coded(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, texts: list[bytes], end_id: int) -> list[bytes]:
        ids_of, end = self.chunks.__getitem__, self._coded([end_id])
        return [b"".join(map(ids_of, t.translate(_CUT).split(b" "))) + end for t in texts]


def vocabulary_width(tokenizer_path: str) -> int:
    """Bytes that hold any id of a tokenizer: 1, 2 or 4."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values())
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def write_shard(uri: str, doc_ids: list[int], coded: list[bytes], width: int) -> str:
    """Write one shard under a new name and return the name. A repeated task writes another file;
    the manifest names only the files of tasks that succeeded."""
    system, path = open_folder(uri)
    name = f"shard-{uuid.uuid4().hex}.tok"
    ends = np.cumsum([len(c) // width for c in coded], dtype=np.int64)
    bounds = encode(ends)
    ids = np.array(doc_ids, "<i8").tobytes()
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(_HEADER.pack(MAGIC, int(ends[-1]) if len(ends) else 0, len(ids), len(bounds), width))
        for c in coded:
            out.write(c)
        out.write(ids)
        out.write(bounds)
    return name


class ShardReader:
    """Documents of one shard, read by position."""

    def __init__(self, uri: str, name: str) -> None:
        system, path = open_folder(uri)
        self._file = system.open_input_file(f"{path}/{name}")
        magic, self.n_ids, n_docs, n_bounds, width = _HEADER.unpack(self._file.read(_HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token shard")
        self.kind = np.dtype(f"<u{width}")
        after = _HEADER.size + self.n_ids * width
        self._file.seek(after)
        self.doc_ids = np.frombuffer(self._file.read(n_docs), "<i8")
        self.bounds = EliasFano(self._file.read(n_bounds))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def span(self, i: int) -> tuple[int, int]:
        return (self.bounds.select(i - 1) if i else 0), self.bounds.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        self._file.seek(_HEADER.size + start * self.kind.itemsize)
        return np.frombuffer(self._file.read((end - start) * self.kind.itemsize), self.kind)

    def close(self) -> None:
        self._file.close()


def _write(batches: Iterable[pa.RecordBatch], uri: str, tokenizer_path: str, width: int,
           end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    encoder = ChunkEncoder.shared(tokenizer_path, width)
    doc_ids: list[int] = []
    coded: list[bytes] = []
    held = number = 0

    def closed() -> pa.RecordBatch:
        name = write_shard(uri, doc_ids, coded, width)
        return pa.RecordBatch.from_pylist([{
            "part": doc_part, "number": number, "file": name, "n_docs": len(doc_ids),
            "n_ids": held // width}], schema=_ARROW_MANIFEST)

    doc_part = 0
    for part, texts in byte_slices(batches):
        doc_part = part.column(part.schema.get_field_index("part"))[0].as_py()
        rows = part.column(part.schema.get_field_index("id")).to_pylist()
        for doc_id, one in zip(rows, encoder.encode(texts, end_id)):
            doc_ids.append(doc_id)
            coded.append(one)
            held += len(one)
            if held >= shard_ids * width:
                yield closed()
                doc_ids, coded, held, number = [], [], 0, number + 1
    if doc_ids:
        yield closed()


_ARROW_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()),
                             ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_MANIFEST = "part int, number int, file string, n_docs long, n_ids long"
#: The id that stands for a null document id in a file; it sorts first, as nulls do.
NULL_ID = -(1 << 63)


def write_store(docs: DataFrame, uri: str, tokenizer_path: str, id_col: str = "doc_id",
                text_col: str = "text", end_id: int = END_ID,
                shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all documents into shards below ``uri``; returns the manifest, one row per shard
    with ``start``, the number of ids in all shards before it.

    Whole texts, in ascending id order; null ids come first and are stored as the least 64-bit
    integer. A null text is empty and holds only the end id. Rows that repeat an id follow one
    another, ordered by their text. An empty table gives no shard.
    """
    scratch = Scratch(docs.sparkSession, "token-manifest")
    make_folder(uri)
    width = vocabulary_width(tokenizer_path)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.col(text_col).alias("text"))
    ordered = (rows.repartitionByRange("id", F.xxhash64("text"))
               .sortWithinPartitions("id", F.xxhash64("text"), "text")
               .withColumn("part", F.spark_partition_id()))
    manifest = ordered.mapInArrow(
        lambda it: _write(it, uri, tokenizer_path, width, end_id, shard_ids), _MANIFEST)
    written = scratch.finish(manifest)
    # One row per shard of millions of ids.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterable[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            reader = ShardReader(uri, shard["file"])
            for first in range(0, len(reader), 1024):
                rows: dict[str, list] = {k: [] for k in ("id", "start", "n_tokens", "ids_crc32", "ids")}
                for i in range(first, min(first + 1024, len(reader))):
                    start, end = reader.span(i)
                    ids = reader.ids(i)
                    rows["id"].append(int(reader.doc_ids[i]))
                    rows["start"].append(shard["start"] + start)
                    rows["n_tokens"].append(end - start)
                    rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    rows["ids"].append(ids.astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(rows["id"], pa.int64()),
                    "start": pa.array(rows["start"], pa.int64()),
                    "n_tokens": pa.array(rows["n_tokens"], pa.int64()),
                    "ids_crc32": pa.array(rows["ids_crc32"], pa.int64()),
                    "ids": pa.array(rows["ids"], pa.list_(pa.int32()))})
            reader.close()


def read_store(manifest: DataFrame, uri: str, id_col: str = "doc_id",
               with_ids: bool = True) -> DataFrame:
    """Per document, read from the shards: the id, ``start``, ``n_tokens``, ``ids_crc32`` and,
    if asked for, ``ids``."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _read(batches, uri):
            yield batch if with_ids else batch.select(["id", "start", "n_tokens", "ids_crc32"])

    # A number of its own keeps Spark from merging the few names into one task.
    shards = manifest.select("file", "start")
    shards = shards.repartitionByRange(max(1, shards.count()), "start")
    schema = "id long, start long, n_tokens long, ids_crc32 long"
    rows = shards.mapInArrow(read, schema + (", ids array<int>" if with_ids else ""))
    return rows.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed(
        "id", id_col)
