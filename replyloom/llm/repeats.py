"""Repeated passages by a depth-limited radix sort of suffixes.

A byte goes when it lies in a string of ``window`` bytes that also starts earlier. Suffixes are
therefore grouped by their first ``window`` bytes and no further: digit by digit, the most
significant first, and a group of one leaves the sort. What remains after the last digit are the
repeated windows, and all but the first place of each are removed.

The digits are chosen so that few records are needed. The most significant digit of a window is its
anchor: of all strings of ``anchor`` bytes inside it the one with the least hash. Equal windows
have equal anchors at equal offsets, and neighbouring windows mostly share one, so a *run* of
windows with one anchor is one record, about one for 30 bytes. The passes are

1. the anchor's bytes: a run whose anchor occurs once in the corpus leaves;
2. all bytes under a run: equal runs are equal window by window, so all but the first place of each
   go, and the first one stands for the others from here on. An anchor under which one run is left
   leaves;
3. the bytes that up to ``STEP`` neighbouring windows of a run have in common;
4. the rest of each window's bytes.

A digit is a 64-bit hash of its bytes, compared only among records whose anchors have the same
64-bit hash. Copies of a whole text are one text from the start. Every grouping is combined
map-side or joins two written tables, so Spark can split what a common passage makes hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import Scratch, byte_slices, field, frame
from replyloom.llm.shingles import mix

WINDOW = 100
ANCHOR = 36
#: Neighbouring windows that share the digit of the third pass.
STEP = 8
#: Window starts of one text that are looked at together, and bytes of several texts.
SEGMENT = 1 << 20
#: Anchors counted together inside a task.
COUNTED = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.uint64(0xC2B2AE3D27D4EB4F)
_LENGTH = np.uint64(0x165667B19E3779F9)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    if len(_powers.get(base, ())) < count:
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:count]


class _Rolled:
    """Hash of any substring of a buffer: a polynomial of random byte values modulo 2**64, read
    off prefix sums and mixed."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[raw] * _power(_BASE, len(raw)), out=self.sums[1:])
        self.down = _power(pow(_BASE, -1, 1 << 64), len(raw) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def all_of(self, size: int) -> np.ndarray:
        count = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[:count])


class Runs(NamedTuple):
    """Runs of windows with one anchor: index of the text, first and last window start and anchor
    as offsets in the text, hash of the anchor, hash of all bytes under the run."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray


def _pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (index of the text, offset, bytes) with every window start in one piece."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - window + 1, SEGMENT):
            piece = text[at:at + SEGMENT + window - 1]
            if group and held + len(piece) > SEGMENT:
                yield group
                group, held = [], 0
            group.append((i, at, piece))
            held += len(piece)
    if group:
        yield group


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def find_runs(texts: list[bytes], window: int, anchor: int) -> Iterator[Runs]:
    """All windows of all texts as runs, some texts at a time."""
    for group in _pieces(texts, window):
        rolled = _Rolled(b"".join(p for _, _, p in group))
        hashes = rolled.all_of(anchor)
        # The low bits are the place, so that the first of equal hashes is taken.
        low = np.uint64((1 << 22) - 1)
        places = np.arange(len(hashes), dtype=np.uint64)
        at = (_least((hashes & ~low) | places, window - anchor + 1) & low).astype(np.int64)
        sizes = np.array([len(p) for _, _, p in group])
        begins = np.cumsum(sizes) - sizes
        counts = sizes - window + 1  # no window crosses from one text to the next
        starts = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
        at = at[starts]
        new = np.empty(len(starts), bool)
        new[0] = True
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        first, at = starts[heads], at[heads]
        last = starts[np.append(heads[1:], len(starts)) - 1]
        whole = mix(rolled.of(first, last + window) + (last - first).astype(np.uint64) * _LENGTH
                    + (at - first).astype(np.uint64) * _PLACE)
        piece = np.searchsorted(begins, first, side="right") - 1
        shift = np.array([offset for _, offset, _ in group])[piece] - begins[piece]
        yield Runs(np.array([i for i, _, _ in group])[piece], first + shift, last + shift,
                   at + shift, hashes[at], whole)


def _packed(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A run in one integer that sorts by its start; both differences are below a window."""
    return first << 20 | (last - first) << 10 | (at - first)


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = packed >> 20
    return first, first + (packed >> 10 & 1023), first + (packed & 1023)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchor_counts(batches: Iterable[pa.RecordBatch], window: int,
                   anchor: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        anchors, counts = np.unique(np.concatenate(held), return_counts=True)
        # Two is as good as more.
        return pa.RecordBatch.from_arrays(
            [_signed(anchors), pa.array(np.minimum(counts, 2).astype(np.int32))],
            names=["anchor", "places"])

    for _, texts in byte_slices(batches):
        held.extend(runs.anchor for runs in find_runs(texts, window, anchor))
        if sum(map(len, held)) >= COUNTED:
            yield counted()
            held = []
    if held:
        yield counted()


def _run_rows(batches: Iterable[pa.RecordBatch], window: int,
              anchor: int) -> Iterator[pa.RecordBatch]:
    for part, texts in byte_slices(batches):
        nodes = part.column(part.schema.get_field_index("node")).to_numpy()
        for runs in find_runs(texts, window, anchor):
            yield pa.RecordBatch.from_arrays(
                [_signed(runs.anchor), _signed(runs.whole), pa.array(nodes[runs.text]),
                 pa.array(_packed(runs.first, runs.last, runs.at))],
                names=["anchor", "digit", "node", "run"])


def _digit_rows(batches: Iterable[pa.RecordBatch], window: int,
                step: int) -> Iterator[pa.RecordBatch]:
    """The asked runs of each text, cut to ``step`` neighbouring windows, with the hash of the
    bytes that these windows have in common."""
    for part, texts in byte_slices(batches, rows=16):
        nodes = part.column(part.schema.get_field_index("node")).to_numpy()
        asked = part.column(part.schema.get_field_index("asked")).to_pylist()
        for node, text, runs in zip(nodes, texts, asked):
            first, last, at = _unpacked(np.array([r["run"] for r in runs], np.int64))
            anchors = np.array([r["anchor"] for r in runs], np.int64)
            # Windows of one part have their distance to the anchor in one multiple of step.
            parts = (at - first) // step - (at - last) // step + 1
            of = np.repeat(np.arange(len(first)), parts)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            turn = (at - last)[of] // step + nth
            at = at[of]
            lo = np.maximum(first[of], at - (turn * step + step - 1))
            hi = np.minimum(last[of], at - turn * step)
            rolled = _Rolled(text)
            # From the last start that the part can have to the end of its first window.
            common = rolled.of(at - turn * step, at - (turn * step + step - 1) + window)
            digit = mix(common + turn.astype(np.uint64) * _PLACE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors[of]), _signed(digit),
                 pa.array(np.full(len(of), node, np.int64)), pa.array(_packed(lo, hi, at))],
                names=["anchor", "digit", "node", "run"])


def _row_keys(batches: Iterable[pa.RecordBatch], id_col: str,
              window: int) -> Iterator[pa.RecordBatch]:
    for part, texts in byte_slices(batches):
        yield frame(part, ["row_id", id_col], {
            "key": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "short": pa.array([t if len(t) < window else None for t in texts], pa.binary())})


def _keyed_texts(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for _, texts in byte_slices(batches):
        long = [t for t in texts if len(t) >= window]
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(t).digest() for t in long], pa.binary()),
             pa.array(long, pa.binary())], names=["key", "text"])


def _removed(runs: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed spans of one text, given its removed windows."""
    first, last, _ = _unpacked(np.sort(np.array(runs, np.int64)))
    ends = np.maximum.accumulate(last + window)
    new = np.append(True, first[1:] > ends[:-1])
    heads = np.flatnonzero(new)
    return first[heads], ends[np.append(heads[1:], len(ends)) - 1]


def _cut(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for part, texts in byte_slices(batches, rows=64):
        marked = part.column(part.schema.get_field_index("runs")).to_pylist()
        spans, kept = [], []
        for text, runs in zip(texts, marked):
            starts, ends = (x.tolist() for x in _removed(runs, window))
            spans.append([{"start": a, "end": b} for a, b in zip(starts, ends)])
            kept.append(b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)])))
        yield frame(part, ["key"], {
            "spans": pa.array(spans, pa.list_(pa.struct(
                [("start", pa.int64()), ("end", pa.int64())]))),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            "kept": pa.array(kept, pa.binary())})


class _Sort:
    """The passes over the distinct long texts of one table."""

    RECORD = "anchor long, digit long, node long, run long"

    def __init__(self, scratch: Scratch, source: DataFrame, nodes: DataFrame, window: int,
                 anchor: int) -> None:
        self.scratch, self.window, self.anchor = scratch, window, anchor
        self.nodes = nodes
        texts = source.select("text").mapInArrow(
            lambda it: _keyed_texts(it, window), "key binary, text binary")
        # Written in the partitions of the grouping, so later steps send records to the texts.
        self.texts = scratch.write_bucketed(
            texts.groupBy("key").agg(F.first("text").alias("text")).join(nodes, "key"), "key")

    def with_text(self, by_node: DataFrame) -> DataFrame:
        return by_node.join(self.nodes, "node").drop("node").join(self.texts, "key")

    def repeated_runs(self) -> DataFrame:
        """Passes 1 and 2: records of runs whose anchor is not alone."""
        window, anchor = self.window, self.anchor
        anchors = self.scratch.write(
            self.texts.select("text").mapInArrow(
                lambda it: _anchor_counts(it, window, anchor), "anchor long, places int")
            .groupBy("anchor").agg(F.sum("places").alias("places"))
            .filter("places > 1").select("anchor"), "anchors")
        runs = self.texts.select("node", "text").mapInArrow(
            lambda it: _run_rows(it, window, anchor), self.RECORD)
        return self.scratch.write(runs.join(anchors, "anchor"), "runs")

    def groups(self, records: DataFrame, least: int) -> DataFrame:
        """First place and size of the groups of equal digits with ``least`` places or more."""
        return self.scratch.write(records.groupBy("anchor", "digit").agg(
            F.min(F.struct("node", "run")).alias("head"), F.count("*").alias("places")
        ).filter(F.col("places") >= least), "groups")

    def later(self, records: DataFrame, groups: DataFrame) -> DataFrame:
        """Records that are not the first of their group."""
        return self.scratch.write(
            records.join(groups.filter("places > 1"), ["anchor", "digit"]).filter(
                (F.col("node") != F.col("head.node")) | (F.col("run") != F.col("head.run"))
            ).select("node", "run"), "later")

    def split(self, records: DataFrame, step: int) -> DataFrame:
        """The next digit of the records, for parts of ``step`` windows."""
        window = self.window
        asked = records.groupBy("node").agg(
            F.collect_list(F.struct("anchor", "run")).alias("asked"))
        return self.scratch.write(
            self.with_text(asked).select("node", "text", "asked").mapInArrow(
                lambda it: _digit_rows(it, window, step), self.RECORD), "digits")

    def removed_windows(self) -> DataFrame:
        """``node, run`` of all windows that start earlier elsewhere."""
        runs = self.repeated_runs()
        heads = self.groups(runs, 1)
        copies = self.later(runs, heads)
        self.scratch.forget(runs)
        several = heads.groupBy("anchor").count().filter("count > 1").select("anchor")
        left = self.scratch.write(
            heads.select("anchor", "digit", "head.node", "head.run").join(
                self.scratch.write(several, "several"), "anchor"), "left")
        self.scratch.forget(heads)
        parts = self.split(left, STEP)
        shared = self.groups(parts, 2)
        windows = self.split(
            parts.join(shared.select("anchor", "digit"), ["anchor", "digit"]), 1)
        self.scratch.forget(left, parts, shared)
        return copies.unionByName(self.later(windows, self.groups(windows, 2)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, anchor: int = ANCHOR,
                   with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: the id, ``n_bytes``, ``spans`` (removed byte ranges, as ``start`` and
    ``end``), ``n_removed``, ``n_spans`` and ``kept_sha256``; ``with_text`` adds the remaining
    bytes as ``kept``, which need not be valid UTF-8.

    A byte of the UTF-8 text is removed when a string of ``window`` bytes around it also starts
    earlier: in a row with a smaller id, or before it in the same text. Matches do not cross texts
    and are judged on the input. Rows of one id count in the order of the table's parts; null ids
    come last. Null text is empty, and texts shorter than ``window`` stay whole. Of equal rows the
    first stays. An empty table gives an empty result. Other columns are not read.
    """
    if not STEP <= anchor <= window - STEP or window > 1000:
        raise ValueError(f"the anchor has {STEP} bytes or more, the window {STEP} more than that "
                         "and 1000 at most")
    scratch = Scratch(docs.sparkSession, "repeats")
    try:
        return scratch.finish(_repeats(scratch, docs, id_col, text_col, window, anchor, with_text))
    except BaseException:
        scratch.drop()
        raise


def _repeats(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, window: int,
             anchor: int, with_text: bool) -> DataFrame:
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    rows = scratch.write(
        source.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(
            lambda it: _row_keys(it, id_col, window),
            f"row_id long, {field(docs, id_col)}, key binary, n_bytes long, short binary"), "rows")
    place = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "row_id")
    firsts = rows.filter(F.col("n_bytes") >= window).groupBy("key").agg(F.min(place).alias("place"))
    # Numbers of range partitions rise with the place of the text's first row.
    nodes = scratch.write(
        firsts.repartitionByRange("place").sortWithinPartitions("place").select(
            "key", F.col("place.row_id").alias("first_row"),
            F.monotonically_increasing_id().alias("node")), "nodes")
    sort = _Sort(scratch, source, nodes.select("key", "node"), window, anchor)
    gone = sort.removed_windows().groupBy("node").agg(F.collect_list("run").alias("runs"))
    spans = "array<struct<start:bigint,end:bigint>>"
    cut = scratch.write(
        sort.with_text(gone).select("key", "text", "runs").mapInArrow(
            lambda it: _cut(it, window),
            f"key binary, spans {spans}, kept_sha256 string, kept binary"), "cut")
    if not with_text:
        cut = cut.drop("kept")
    else:
        cut = sort.texts.select("key", "text").join(cut, "key", "left").withColumn(
            "kept", F.coalesce("kept", "text")).drop("text")
    # Only the first row of a long text has spans of its own.
    own = nodes.join(cut, "key", "left").drop("key", "node")
    joined = rows.join(own, F.col("row_id") == F.col("first_row"), "left")
    copy = (F.col("n_bytes") >= window) & F.col("first_row").isNull()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast(spans)
    out = joined.withColumn(
        "spans", F.when(copy, whole).otherwise(F.coalesce("spans", none))
    ).withColumn("kept_sha256", F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(
        F.coalesce("kept_sha256", F.lower(F.hex("key")))))
    more = []
    if with_text:
        more = [F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", "short")).alias("kept")]
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(id_col, "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans", *more)
