"""Elias-Fano coding of a non-decreasing sequence, with select.

Each value is split: the low ``l`` bits are stored as they are, the rest in unary as set bits
of a bitmap, value i at position (v >> l) + i. That is about 2 + l bits a value. The position of
every 256th set bit is kept in 32 bits, so that one value is found without reading the others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

STEP = 256
HEAD = struct.Struct("<QQB")


def encode(values: np.ndarray) -> bytes:
    """Non-decreasing non-negative integers below 2^63 as bytes."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    lows = np.packbits(bits[:, :low].ravel(), bitorder="little")
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bitmap = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
    bitmap[ones] = 1
    highs = np.packbits(bitmap, bitorder="little")
    samples = ones[::STEP].astype("<u4")
    return HEAD.pack(n, len(highs), low) + samples.tobytes() + lows.tobytes() + highs.tobytes()


class Sequence:
    """Reads an encoded sequence in place."""

    def __init__(self, data: bytes | memoryview):
        self.n, n_highs, self.low = HEAD.unpack_from(data)
        at = HEAD.size
        self.samples = np.frombuffer(data, "<u4", -(-self.n // STEP), at)
        at += 4 * len(self.samples)
        self.lows = np.frombuffer(data, np.uint8, -(-self.n * self.low // 8), at)
        at += len(self.lows)
        self.highs = np.frombuffer(data, np.uint8, n_highs, at)
        self.size = at + n_highs

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Value number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // STEP])
        byte, want = start // 8, i % STEP
        want += int(np.unpackbits(self.highs[byte : byte + 1], bitorder="little")[: start % 8].sum())
        while True:
            ones = np.flatnonzero(np.unpackbits(self.highs[byte : byte + 64], bitorder="little"))
            if want < len(ones):
                high = 8 * byte + int(ones[want]) - i
                break
            want -= len(ones)
            byte += 64
        first = i * self.low
        part = np.unpackbits(self.lows[first // 8 : (first + self.low) // 8 + 1], bitorder="little")
        part = part[first % 8 : first % 8 + self.low]
        return (high << self.low) | sum(1 << j for j in np.flatnonzero(part).tolist())

    def block(self, b: int) -> np.ndarray:
        """Values number ``STEP`` * b to before ``STEP`` * (b + 1), by one select for all of them: the
        sample tells where their set bits begin, and nothing else is decoded."""
        first = b * STEP
        n = min(STEP, self.n - first)
        if n <= 0:
            raise IndexError(b)
        begin = int(self.samples[b])
        byte = begin // 8
        until = int(self.samples[b + 1]) // 8 + 1 if b + 1 < len(self.samples) else len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[byte:until], bitorder="little")) + 8 * byte
        ones = ones[ones >= begin][:n]
        at = first * self.low
        bits = np.unpackbits(self.lows[at // 8 : -(-(at + n * self.low) // 8)], bitorder="little")
        bits = bits[at % 8 : at % 8 + n * self.low].reshape(n, self.low)
        lows = bits @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
        return ((ones - np.arange(first, first + n)) << self.low) + lows

    def blocks(self) -> Iterator[np.ndarray]:
        """All values in order, a block at a time."""
        return map(self.block, range(len(self.samples)))

    def all(self) -> np.ndarray:
        """All values as int64."""
        return np.concatenate([np.zeros(0, dtype=np.int64), *self.blocks()])
