"""Hilbert curve positions of integer points, many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions (uint64) on the Hilbert curve of an n x dims array of integers below 2**bits; dims * bits <= 64.

    Gray-code form: from the highest bit down, the axes are exchanged and inverted as the
    sub-cube's orientation asks; then the bits of all axes are interleaved.
    """
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(dims):
            flip = (x[i] & high) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        fix ^= np.where((x[dims - 1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= fix
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key
