"""Elias-Fano coding of a non-decreasing sequence, with a select structure.

Of every value the low bits are stored as they are; the high bits are stored in unary, as one set
bit per value at position ``high + index``. A sample of the positions of every 64th set bit lets
``select`` start next to the bit it looks for. The space is about ``2 + log2(universe / n)`` bits a
value. The layout is little-endian:

    n, universe: 8 bytes each; low_bits: 1 byte; number of bytes of the low and of the high part:
    8 bytes each; low part; high part; samples, 4 bytes each.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

_HEADER = struct.Struct("<QQBQQ")
_SAMPLE = 64


def encode(values: Sequence[int] | np.ndarray) -> bytes:
    """Code a non-decreasing sequence of integers from 0 on (may be empty)."""
    v = np.asarray(values, np.int64)
    n = len(v)
    universe = int(v[-1]) + 1 if n else 0
    if n and (v[0] < 0 or (np.diff(v) < 0).any()):
        raise ValueError("values must not decrease and must not be negative")
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    low = (v[:, None] >> np.arange(low_bits)) & 1
    low_part = np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes()
    at = (v >> low_bits) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    high[at] = 1
    high_part = np.packbits(high, bitorder="little").tobytes()
    samples = at[::_SAMPLE].astype("<u4").tobytes()
    return _HEADER.pack(n, universe, low_bits, len(low_part), len(high_part)) + low_part \
        + high_part + samples


class EliasFano:
    """Random access to a coded sequence without expanding it."""

    def __init__(self, data: bytes) -> None:
        self.n, self.universe, self.low_bits, n_low, n_high = _HEADER.unpack_from(data)
        start = _HEADER.size
        self._low = data[start:start + n_low]
        self._high = data[start + n_low:start + n_low + n_high]
        self._samples = np.frombuffer(data, "<u4", -(-self.n // _SAMPLE), start + n_low + n_high)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The ``i``-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self._samples[i // _SAMPLE])
        left = i % _SAMPLE  # set bits still to pass
        byte = at >> 3
        bits = self._high[byte] >> (at & 7) << (at & 7)
        while (count := bits.bit_count()) <= left:
            left -= count
            byte += 1
            bits = self._high[byte]
        for _ in range(left):
            bits &= bits - 1
        position = (byte << 3) + (bits & -bits).bit_length() - 1
        return ((position - i) << self.low_bits) | self._low_of(i)

    def _low_of(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        chunk = int.from_bytes(self._low[first >> 3:(last + 7) >> 3], "little")
        return (chunk >> (first & 7)) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values, decoded at once."""
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self._high, np.uint8),
                                            bitorder="little")) - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self._low, np.uint8), bitorder="little",
                             count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return (high << self.low_bits) | low
