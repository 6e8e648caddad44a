"""Rabin-Karp hashes of all token windows of a text, as array operations modulo 2**64."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096) * 2, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that order and low bits are free of the polynomial's structure."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(_BASE, len(hashes)), out=total[1:])
    return total


def window_at(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The hash of the run of ``size`` words at each start."""
    return mix((sums[starts + size] - sums[starts]) * _power(_INVERSE, len(sums))[starts])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; empty if there are fewer."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    total = prefix_sums(hashes)
    return mix((total[size:] - total[:-size]) * _power(_INVERSE, n - size + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
