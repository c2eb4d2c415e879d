"""64-bit hashes of many short segments at once, in numpy."""

from __future__ import annotations

import numpy as np

_ODD, _MIX, _BYTE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _ODD)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def segment_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of symbols[start:end] for each of the segments, which are in order, not empty, and apart or adjacent.
    Each is a polynomial over spread symbol values."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    at = np.arange(int(lengths.sum()), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inner = at - np.repeat(first, lengths)
    spread = (symbols[np.repeat(starts, lengths) + inner].astype(np.uint64) + np.uint64(1)) * _BYTE
    spread ^= spread >> np.uint64(29)
    spread *= _powers(longest)[inner]
    return mix(np.add.reduceat(spread, first) ^ lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive word hashes."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + words[i : i + n] * np.uint64(2 * i + 3))
    return out
