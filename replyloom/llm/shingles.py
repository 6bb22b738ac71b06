"""Hashes of words and word shingles, computed for many texts at once with numpy.

A word's hash is the polynomial of its bytes' random values modulo 2**64, read off prefix sums of
the whole buffer, then mixed with its length. The byte table gives A-Z the values of a-z. Words of
more than ``LONG_WORD`` bytes, where such polynomials have known collisions, get a proper hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text worked on at a time.
SEGMENT = 1 << 20
LONG_WORD = 1000

_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[ord("A"):ord("Z") + 1] = _VALUES[ord("a"):ord("z") + 1]
_STEPS = tuple(np.uint64(m) for m in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def _power(which: str) -> np.ndarray:
    """Powers of the base, or of its inverse, for every place of a segment."""
    if which not in _powers:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(SEGMENT + 1, base, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of at most ``SEGMENT`` bytes."""
    raw = np.frombuffer(data, np.uint8)
    word = np.empty(len(raw) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_BLANK[raw], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[raw] * _power("up")[:len(raw)], out=sums[1:])
    lengths = ends - starts
    hashes = (sums[ends] - sums[starts]) * _power("down")[starts]
    hashes = mix(hashes + lengths.astype(np.uint64) * _STEPS[1])
    for i in np.flatnonzero(lengths > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].lower())
    return hashes, starts


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of one text of any length."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + SEGMENT)
        while end < len(text) and end > at and not _BLANK[text[end]]:
            end -= 1
        if end == at:  # one word fills the segment
            end = at + SEGMENT
            while end < len(text) and not _BLANK[text[end]]:
                end += 1
            words = text[at:end].split()
            parts.append(np.array([xxhash.xxh3_64_intdigest(w.lower()) if len(w) > LONG_WORD
                                   else int(_of_segment(w)[0][0]) for w in words], np.uint64))
        else:
            parts.append(_of_segment(text[at:end])[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _shingled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle that starts at each word, as far as it fits."""
    width = min(size, len(words))
    count = len(words) - width + 1 if width else 0
    # A short text's single shingle is told apart from full ones by its length.
    total = np.full(count, width if width < size else 0, np.uint64)
    for k in range(width):
        total = mix(total + words[k:k + count] * _STEPS[k % 4])
    return total


def _distinct(tokens: np.ndarray) -> np.ndarray:
    tokens.sort()
    new = np.empty(len(tokens), bool)
    new[:1] = True
    np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
    return tokens[new]


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words.

    A text with fewer words is one shingle, a text without words has none.
    """
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and total + len(texts[last]) + 1 <= SEGMENT:
            total += len(texts[last]) + 1
            last += 1
        if last == first:
            yield _distinct(_shingled(word_hashes(texts[first]), size))
            first += 1
            continue
        group = texts[first:last]
        words, starts = _of_segment(b" ".join(group))
        offsets = np.cumsum([len(t) + 1 for t in group])
        cuts = [0, *np.searchsorted(starts, offsets).tolist()]
        shingles = _shingled(words, size) if len(words) >= size else np.empty(0, np.uint64)
        for a, b in zip(cuts, cuts[1:]):
            if b - a >= size:
                yield _distinct(shingles[a:b - size + 1])
            else:
                yield _shingled(words[a:b], size)
        first = last
