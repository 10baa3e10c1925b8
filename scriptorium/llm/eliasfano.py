"""Elias-Fano code of a non-decreasing sequence of integers, with a select structure.

n values up to u take about n * (2 + log2(u / n)) bits: the low bits of each value as they are, the high parts in
unary.  Every 256th one bit of the unary part has its place recorded, so that value i is found by scanning a few
words from there; no table of 64-bit offsets is held.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBxxxIII")  # count, smallest value (as unsigned), low bits, bytes of low, of high, samples
SAMPLE = 256


def encode(values: np.ndarray) -> bytes:
    """The code of non-decreasing 64-bit integers; an empty sequence is allowed."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if n == 0:
        return _HEAD.pack(0, 0, 0, 0, 0, 0)
    if (values[1:] < values[:-1]).any():
        raise ValueError("values must not decrease")
    base = int(values[0])
    v = values.astype(np.uint64) - np.uint64(base % 2**64)
    width = max(0, (int(v[-1]) // n).bit_length() - 1)
    low = np.zeros((n, width), np.uint8)
    for b in range(width):
        low[:, b] = (v >> np.uint64(b)) & np.uint64(1)
    ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    low_bytes, high_bytes = np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4")
    return _HEAD.pack(n, base % 2**64, width, len(low_bytes), len(high_bytes), len(samples)) + low_bytes + high_bytes + samples.tobytes()


class Sequence:
    """A coded sequence: ``len``, ``select(i)`` for one value, ``values()`` for all."""

    def __init__(self, data: bytes):
        self.n, self.base, self.width, a, b, c = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.low = np.frombuffer(data, np.uint8, a, at)
        self.high = np.frombuffer(data, np.uint8, b, at + a)
        self.samples = np.frombuffer(data, "<u4", c, at + a + b)

    def __len__(self) -> int:
        return self.n

    def _signed(self, v: int) -> int:
        v = (v + self.base) % 2**64
        return v - 2**64 if v >= 2**63 else v

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place // 8
        byte = int(self.high[at]) & (0xFF << (place % 8))
        while (found := byte.bit_count()) <= left:
            left -= found
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        one = 8 * at + (byte & -byte).bit_length() - 1
        low = 0
        for b in range(self.width):
            k = i * self.width + b
            low |= (int(self.low[k // 8]) >> (k % 8) & 1) << b
        return self._signed((one - i) << self.width | low)

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)[: self.n]
        v = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.width)
        bits = np.unpackbits(self.low, count=self.n * self.width, bitorder="little").reshape(self.n, self.width)
        for b in range(self.width):
            v |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return (v + np.uint64(self.base)).astype(np.int64)
