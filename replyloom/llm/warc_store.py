"""WARC records in seekable Zstandard bundles.

A bundle is one file of independent Zstandard frames, each with a few records, and a footer: a
skippable frame with a seek table in the layout of the public seekable format (per frame its
compressed and its decompressed size, then the number of frames, a descriptor byte and the magic
number). Any Zstandard reader reads a bundle from end to end; a reader with the seek table
decompresses one frame. The index maps a record id to its bundle, frame and offset in the frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import Scratch, byte_slices, frame
from replyloom.llm.files import make_folder, open_folder
from replyloom.operators.keys import lookup_join
from replyloom.session import ship_package

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: A frame is closed once it holds so many bytes, a bundle once it holds so many compressed ones.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
LEVEL = 3
_ENTRY = struct.Struct("<II")
_FOOTER = struct.Struct("<IBI")
#: Stands for a null id in join keys.
NULL_ID = -(1 << 63)
_DATE = "1970-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, url: str, payload: bytes, digest: str,
                 refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without it."""
    content = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}",
            f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(content)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def parse_record(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, content and end of the record at ``start``."""
    split = data.index(b"\r\n\r\n", start)
    lines = data[start:split].decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                   for line in lines[1:])
    begin = split + 4
    end = begin + int(headers["Content-Length"])
    return headers, data[begin:end], end + 4


class BundleWriter:
    """Writes one bundle; ``add`` returns the frame and the offset in it."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES) -> None:
        system, path = open_folder(uri)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self._out = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self._packer = zstandard.ZstdCompressor(level=LEVEL)
        self._frame_bytes = frame_bytes
        self._held: list[bytes] = []
        self._size = 0
        self._frames: list[tuple[int, int]] = []
        self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        place = len(self._frames), self._size
        self._held.append(record)
        self._size += len(record)
        if self._size >= self._frame_bytes:
            self._flush()
        return place

    def _flush(self) -> None:
        if self._held:
            packed = self._packer.compress(b"".join(self._held))
            self._out.write(packed)
            self._frames.append((len(packed), self._size))
            self.written += len(packed)
            self._held, self._size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(_ENTRY.pack(*f) for f in self._frames)
        footer = _FOOTER.pack(len(self._frames), 0, SEEKABLE_MAGIC)
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)))
        self._out.write(table + footer)
        self._out.close()


class BundleReader:
    """Reads frames of one bundle by its seek table."""

    def __init__(self, uri: str, name: str) -> None:
        system, path = open_folder(uri)
        full = f"{path}/{name}"
        self._file = system.open_input_file(full)
        size = self._file.size()
        self._file.seek(size - _FOOTER.size)
        count, _, magic = _FOOTER.unpack(self._file.read(_FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{name} has no seek table")
        self._file.seek(size - _FOOTER.size - count * _ENTRY.size)
        table = self._file.read(count * _ENTRY.size)
        self.frames, at = [], 0
        for packed, plain in _ENTRY.iter_unpack(table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self._file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self._file.read(packed), max_output_size=plain)

    def close(self) -> None:
        self._file.close()


def _digests(batches: Iterable[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for part, payloads in byte_slices(batches, "html"):
        yield frame(part, keep, {
            "digest": pa.array([payload_digest(p) for p in payloads], pa.string()),
            "n_bytes": pa.array([len(p) for p in payloads], pa.int64())})


def _write(batches: Iterable[pa.RecordBatch], uri: str, frame_bytes: int,
           bundle_bytes: int) -> Iterator[pa.RecordBatch]:
    """Write the records of one partition, whose rows come sorted by id and digest."""
    bundle, held, last, repeat = None, [], None, 0

    def closed() -> pa.RecordBatch:
        bundle.close()
        return pa.RecordBatch.from_pylist(
            [{"bundle": bundle.name, "frame": f, "frame_offset": o, "record_id": r}
             for r, (f, o) in held],
            schema=pa.schema([("bundle", pa.string()), ("frame", pa.int32()),
                              ("frame_offset", pa.int64()), ("record_id", pa.string())]))

    for part, payloads in byte_slices(batches, "html"):
        columns = {n: part.column(part.schema.get_field_index(n)).to_pylist()
                   for n in ("id", "url", "keep_id", "grouped", "stays", "digest")}
        for i, payload in enumerate(payloads):
            own, digest = columns["id"][i], columns["digest"][i]
            # Rows repeated with id and payload are told apart by a count.
            repeat = repeat + 1 if last == (own, digest) else 0
            last = own, digest
            record_id = _record_id(own, digest, repeat)
            refers = None
            if columns["grouped"][i] and (not columns["stays"][i] or repeat):
                refers = _record_id(columns["keep_id"][i], digest, 0)
            bundle = bundle or BundleWriter(uri, frame_bytes)
            record = record_bytes(record_id, columns["url"][i] or "", payload, digest, refers)
            held.append((record_id, bundle.add(record)))
            if bundle.written >= bundle_bytes:
                yield closed()
                bundle, held = None, []
    if bundle:
        yield closed()


def _record_id(own: object, digest: str, repeat: int) -> str:
    return f"urn:page:{'null' if own is None else own}:{digest[:16]}:{repeat}"


def write_archives(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES,
                   bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per page; returns the index: ``record_id, bundle, frame, frame_offset``.

    Of records with equal payloads of at least ``min_bytes``, the one with the largest id is the
    response and the others revisit it; a null id is the smallest. Rows repeated with the same id
    and payload become one record of their kind and revisits of the response. A null payload is
    empty, a null URL too. An empty table writes no bundle.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    make_folder(uri)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    keyed = rows.select("id", "html").mapInArrow(lambda it: _digests(it, ["id"]),
                                                 "id long, digest string, n_bytes long")
    keyed = scratch.write(keyed, "digests")
    # The payload length is part of the key; rows below the limit stand alone.
    keyed = keyed.withColumn("payload", F.struct("digest", "n_bytes"))
    groups = keyed.filter(F.col("n_bytes") >= min_bytes).groupBy(F.col("payload").alias("group")).agg(
        F.max(F.struct("id")).alias("best"), F.count("*").alias("copies")).filter("copies > 1")
    # A third of all pages may be empty: a join that AQE can split.
    marked = lookup_join(keyed, groups, "payload", "group")
    verdicts = scratch.write(
        marked.select(F.coalesce("id", F.lit(NULL_ID)).alias("v_key"),
                      F.col("digest").alias("v_digest"), F.col("best.id").alias("keep_id"),
                      F.lit(True).alias("marked")).distinct(), "verdicts")
    key = F.coalesce("id", F.lit(NULL_ID)).alias("key")
    digested = rows.mapInArrow(
        lambda it: _digests(it, ["id", "url", "html"]),
        "id long, url string, html string, digest string, n_bytes long")
    # One shuffle brings equal rows together; the join below keeps it.
    placed = digested.select("*", key).repartition("key", "digest").join(
        verdicts.withColumnRenamed("v_key", "key").withColumnRenamed("v_digest", "digest"),
        ["key", "digest"], "left")
    index = (placed.select(
        "id", "key", "url", "html", "digest", "keep_id", F.col("marked").isNotNull().alias("grouped"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("stays"))
        .sortWithinPartitions("key", "digest")
        .mapInArrow(lambda it: _write(it, uri, frame_bytes, bundle_bytes),
                    "bundle string, frame int, frame_offset long, record_id string"))
    return scratch.finish(index)


def _read(batches: Iterable[pa.RecordBatch], uri: str,
          with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column(0).to_pylist():
            reader = BundleReader(uri, name)
            for number in range(len(reader.frames)):
                data, at, rows = reader.frame(number), 0, []
                while at < len(data):
                    start = at
                    headers, content, at = parse_record(data, at)
                    refers = headers.get("WARC-Refers-To")
                    rows.append({
                        "id": _id_of(headers["WARC-Record-ID"]),
                        "url": headers["WARC-Target-URI"],
                        "payload_bytes": int(headers["X-Payload-Length"]) if refers else len(content),
                        "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if refers else payload_digest(content),
                        "record_type": headers["WARC-Type"],
                        "refers_to": _id_of(refers) if refers else None,
                        "bundle": name, "frame": number, "frame_offset": start,
                    } | ({"payload": content} if with_payload else {}))
                yield pa.RecordBatch.from_pylist(rows, schema=_read_schema(with_payload))
            reader.close()


def _id_of(urn: str) -> int | None:
    own = urn.strip("<>").split(":")[2]
    return None if own == "null" else int(own)


def _read_schema(with_payload: bool) -> pa.Schema:
    return pa.schema([
        ("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()),
        *([("payload", pa.binary())] if with_payload else [])])


def read_archives(index: DataFrame, uri: str, id_col: str = "page_id",
                  with_payload: bool = False) -> DataFrame:
    """Every record of the bundles that ``index`` names, in no order.

    Payload size and digest of a response are taken anew from the bytes read; those of a revisit
    are what its header states. ``with_payload`` adds the payload (empty for revisits).
    """
    ship_package(index.sparkSession)
    schema = ("id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, bundle string, frame int, frame_offset long")
    # A number of its own keeps Spark from merging the few names into one task.
    bundles = index.select("bundle").distinct()
    bundles = bundles.repartitionByRange(max(1, bundles.count()), "bundle")
    rows = bundles.mapInArrow(lambda it: _read(it, uri, with_payload),
                              schema + (", payload binary" if with_payload else ""))
    return rows.withColumnRenamed("id", id_col)


def fetch_record(index_row: dict, uri: str) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record by its index row: reads the seek table and one frame."""
    reader = BundleReader(uri, index_row["bundle"])
    try:
        headers, content, _ = parse_record(reader.frame(index_row["frame"]), index_row["frame_offset"])
    finally:
        reader.close()
    return headers, content
