"""Hashes of all k-grams of a text, as arrays."""

from __future__ import annotations

import numpy as np

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams: those of 2, 4, 8 ... characters are put together by the bits of k."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, length, power = codes.astype(np.uint64), 1, _BASE
    total, have = None, 0
    while True:
        if k & length:
            tail = part[have : have + n]
            total = tail if total is None else total * np.uint64(power) + tail
            have += length
        if have == k:
            break
        part = part[:-length] * np.uint64(power) + part[length:]
        power, length = power * power % 2**64, length * 2
    mixed = (total ^ (total >> np.uint64(31))) * _MIX
    return mixed ^ (mixed >> np.uint64(29))
