"""Fingerprints of substrings from prefix sums, over whole buffers at a time.

A byte b at place i adds code(b) * BASE^i modulo 2^64. The difference of two prefix sums times
BASE^-start depends on the bytes alone. Codes are fixed random 64-bit numbers and the result
goes through a bijective mixer, so every output bit depends on every byte.
"""

from __future__ import annotations

import numpy as np

from curbside.llm.common import mixed

BASE = 0x9E3779B97F4A7C15 | 5
CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)

_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0..n-1 and BASE^-0..-(n-1), kept by the worker up to 4M places."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    up, down = _POWERS[0][:n], _POWERS[1][:n]
    if n > 4 << 20:
        _POWERS[:] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
    return up, down


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes before each place, and of all."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(CODES[data] * powers(len(data))[0], out=out[1:])
    return out


def fingerprints(sums: np.ndarray, start: np.ndarray, end: np.ndarray | int) -> np.ndarray:
    """64-bit fingerprints of the byte ranges [start, end)."""
    down = powers(len(sums))[1]
    return mixed((sums[end] - sums[start]) * down[start])


WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of lower-cased texts, and the number of words of each."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    inside = np.concatenate([[False], WORD_BYTE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    words = fingerprints(prefix_sums(data), start, end) if len(start) else np.zeros(0, np.uint64)
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))
    return words, counts
