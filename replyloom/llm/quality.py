"""Line-first cleaning and quality rules.

Each line of a document is judged on its own: symbols and shouting (punctuation), menus and
bread crumbs (navigation), stock phrases (boilerplate) and words that only repeat. Lines that
fail are removed. A document that thereby loses too many of its words is rejected, and so is one
that fails the base counts over its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import byte_slices, field, frame
from replyloom.session import ship_package

#: Stock phrases of web pages, in lower case. A line that holds one is boilerplate.
BOILERPLATE = (
    b"all rights reserved", b"terms of use", b"terms of service", b"privacy policy",
    b"cookie policy", b"use of cookies", b"uses cookies", b"enable javascript",
    b"javascript is disabled", b"lorem ipsum", b"sign up for our newsletter",
    b"subscribe to our newsletter", b"click here to", b"powered by", b"skip to content",
    b"licensed under the", b"permission is hereby granted", b"without warranty of any kind",
)
_STOCK = re.compile(b"|".join(map(re.escape, BOILERPLATE)))
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\r\x0b\x0c"
_MENU_WORDS = frozenset((b"|", b">", b"<", b"/", b"\xc2\xbb", b"\xc2\xab", b"\xe2\x80\xba",
                         b"\xe2\x80\xa2", b"\xc2\xb7", b"::"))


@dataclass(frozen=True)
class LineRules:
    """Thresholds per line, and the share of words a document has to keep."""

    max_symbols_per_word: float = 0.3
    max_shouts_per_word: float = 0.3
    max_menu_share: float = 0.15
    max_braces: int = 1
    repeat_min_words: int = 8
    min_distinct_share: float = 0.2
    min_kept_share: float = 0.5


def line_fault(line: bytes, words: list[bytes], rules: LineRules) -> str | None:
    """The rule that a line fails, or None. ``words`` are the line's words, at least one."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, _SYMBOLS))
    if symbols:
        if sum(w in _MENU_WORDS for w in words) > rules.max_menu_share * n:
            return "navigation"
        if symbols > rules.max_symbols_per_word * n:
            return "punctuation"
    if b"!!" in line and line.count(b"!!") > rules.max_shouts_per_word * n:
        return "punctuation"
    if b"{" in line and line.count(b"{") + line.count(b"}") > rules.max_braces:
        return "punctuation"
    if n >= rules.repeat_min_words and len(set(words)) < rules.min_distinct_share * n:
        return "repetition"
    if _STOCK.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in some window of three words that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # three ids would not fit 63 bits; number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True,
                              return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:k + n - 2] |= twice
    return int(covered.sum())


def judge_text(text: bytes, rules: LineRules) -> tuple[dict, bytes]:
    """Counts and verdict of one text, and the text without the lines that fail."""
    words = text.split()
    n = len(words)
    n_chars = len(text.decode("utf-8", "replace"))
    earlier: set[bytes] = set()
    duplicates = kept_words = dropped = n_lines = 0
    kept: list[bytes] = []
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            kept.append(line)
            continue
        n_lines += 1
        if line in earlier:
            duplicates += 1
        else:
            earlier.add(line)
        if line_fault(line, own, rules):
            dropped += 1
        else:
            kept_words += len(own)
            kept.append(line)
    repeats = repeated_words(words)
    base_failed = n < 50 or 100 * repeats > 50 * n
    return {
        "n_words": n, "word_chars": n_chars - (len(text) - len(text.translate(None, _BLANKS))),
        "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)),
        "n_dup_lines": duplicates, "n_repeat_words": repeats, "n_lines": n_lines,
        "n_lines_dropped": dropped, "words_kept": kept_words, "base_failed": base_failed,
        "kept": not base_failed and kept_words >= rules.min_kept_share * n,
    }, b"\n".join(kept)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
           "n_lines_dropped", "words_kept")
_VERDICTS = ("base_failed", "kept")


def _judged(batches: Iterable[pa.RecordBatch], id_col: str, text_col: str, rules: LineRules,
            with_text: bool) -> Iterator[pa.RecordBatch]:
    for part, texts in byte_slices(batches, text_col):
        rows = [judge_text(t, rules) for t in texts]
        more: dict = {c: pa.array([r[c] for r, _ in rows], pa.int64()) for c in _COUNTS}
        more |= {c: pa.array([r[c] for r, _ in rows], pa.bool_()) for c in _VERDICTS}
        if with_text:
            more["clean_text"] = pa.array([t for _, t in rows], pa.binary()).cast(pa.string())
        yield frame(part, [id_col], more)


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """Per document: the id, counts over the whole text, ``base_failed`` and ``kept``.

    ``with_text`` adds ``clean_text``, the lines that pass. A null or blank text has no words
    and fails. One narrow pass: nothing is shuffled, repeated rows come back repeated, and other
    columns are not read.
    """
    ship_package(docs.sparkSession)
    schema = ", ".join([field(docs, id_col)] + [f"{c} long" for c in _COUNTS]
                       + [f"{c} boolean" for c in _VERDICTS] + ["clean_text string"] * with_text)
    return docs.select(id_col, text_col).mapInArrow(
        lambda it: _judged(it, id_col, text_col, rules, with_text), schema)


def _cleaned(batches: Iterable[pa.RecordBatch], text_col: str, count_col: str | None,
             rules: LineRules) -> Iterator[pa.RecordBatch]:
    for part, texts in byte_slices(batches, text_col):
        rows = [judge_text(t, rules) for t in texts]
        stay = pa.array([r["kept"] for r, _ in rows], pa.bool_())
        clean = pa.array([t for _, t in rows], pa.binary()).cast(pa.string())
        arrays = []
        for name, column in zip(part.schema.names, part.columns):
            if name == text_col:
                column = clean
            elif name == count_col:
                column = pa.array([len(t.decode()) for _, t in rows]).cast(column.type)
            arrays.append(column)
        yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names).filter(stay)


def clean_documents(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars",
                    rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` without rejected documents, and their texts without the lines that fail.

    Columns and types are unchanged; ``count_col``, where there is one, gets the new length. Null,
    empty and blank texts have no words and are rejected. Every row is judged by itself: repeated
    rows stay repeated, ids do not matter, an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    count = count_col if count_col in docs.columns else None
    return docs.mapInArrow(lambda it: _cleaned(it, text_col, count, rules), docs.schema)
