"""Hilbert keys of integer points, vectorised."""

from __future__ import annotations

import numpy as np


def keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of each point on the Hilbert curve through the grid of
    ``2**bits`` cells a side.  ``points``: (rows, dims) integers in the grid;
    ``dims * bits`` is at most 63.  Neighbouring keys are neighbouring cells.

    The curve's coordinates are turned in place, from the highest bit down
    (exchange or invert the lower bits of the first coordinate), then Gray
    decoded, and their bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("the key does not fit 63 bits")
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out
