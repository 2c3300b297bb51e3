"""Monotone sequences in Elias-Fano form over NumPy, for values in bulk: access, and search by successor.

Each value's low bits lie side by side in a bit string; its high part is one set bit, at high + index, of a
bit vector, with the number of ones before each block of words as a directory for both ones and zeros.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4  # words
U = np.uint64


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, side by side, lowest bit first; 8 bytes of room behind."""
    parts = []
    for at in range(0, len(values), 1 << 20):  # 2**20 values fill whole bytes, so parts can be put together
        v = values[at : at + (1 << 20)].astype("<u8")
        bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        parts.append(np.packbits(bits.reshape(-1), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


def unpacked_bits(data: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), U)
    at = index * width
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return words[at >> 3] >> (at & 7).astype(U) & U((1 << width) - 1)


def select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The places of the k-th set bits (from 0) of words; before: how many stand before each block of BLOCK words."""
    block = np.searchsorted(before, k, "right") - 1
    left = k - before[block]
    word = block * BLOCK
    w = words[word]
    n = np.bitwise_count(w).astype(np.int64)
    behind = np.flatnonzero(left >= n)
    while len(behind):  # BLOCK - 1 times at most
        left[behind] -= n[behind]
        word[behind] += 1
        w[behind] = words[word[behind]]
        n[behind] = np.bitwise_count(w[behind])
        behind = behind[left[behind] >= n[behind]]
    place = word << 6
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(w & U((1 << width) - 1))
        up = left >= n
        left -= n * up
        w = w >> (up * U(width)).astype(U)
        place += up * width
    return place


class EliasFano:
    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """values: int64, not negative, never falling."""
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        high = (values >> width) + np.arange(n)
        size = -(-((top >> width) + n + 2) // (64 * BLOCK)) * 64 * BLOCK
        bits = np.zeros(size, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.cumsum([0, *np.bitwise_count(words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)[:-1]])
        return cls(n, width, packed_bits(values & ((1 << width) - 1), width) if width else np.zeros(8, np.uint8), words, ones.astype("<i8"))

    def get(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, np.int64)
        high = select(self.high, self.ones, index) - index
        return (high << self.width) + unpacked_bits(self.low, self.width, index).astype(np.int64)

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        if len(some):
            k = high[some] - 1
            zeros = np.arange(len(self.ones)) * (64 * BLOCK) - self.ones
            out[some] = select(_Inverted(self.high), zeros, k) - k
        return out

    def successor(self, target: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least index in begin:end (else end) whose value is at least the target. Values rise within begin:end."""
        high = target >> self.width
        most = (int(self.high.size) << 6) - self.n - 1  # zeros there are, less one
        beyond = high >= most
        high = np.minimum(high, most - 1)
        lo = np.clip(self.below(high), begin, end)
        hi = np.clip(self.below(high + 1), begin, end)
        low = (target & ((1 << self.width) - 1)).astype(U)
        lo = np.where(beyond, end, lo)
        hi = np.where(beyond, end, hi)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = unpacked_bits(self.low, self.width, mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo


class _Inverted:
    """Reads the words of a bit vector with ones and zeros swapped."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ~self.words[at]
