"""Place on a Hilbert curve through many dimensions, for whole batches of points."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Keys that sort as the points lie on the curve.

    ``cells`` holds one row of ``bits``-bit coordinates a point. The coordinates are turned into
    the transposed curve index (Skilling, 2004), whose bits are read across the dimensions, the
    highest first.
    """
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    bit = 1 << (bits - 1)
    while bit > 1:
        low = np.uint32(bit - 1)
        for axis in x:
            swap = np.where(axis & bit, np.uint32(0), (x[0] ^ axis) & low)
            flip = np.where(axis & bit, low, np.uint32(0))
            axis ^= swap
            x[0] ^= swap ^ flip
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, np.uint32(bit - 1), np.uint32(0))
        bit >>= 1
    x ^= turn
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(planes.T, axis=1)]
