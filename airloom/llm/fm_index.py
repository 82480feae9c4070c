"""A compressed full-text index over sequences of 32-bit symbols, for many patterns at once, inside tasks.

The suffixes of the text are sorted by their first ``DEPTH`` symbols, which is all that patterns of at most that length
need. The transformed text is kept as a wavelet matrix: one bit vector per bit of a symbol with counts per 64 bits.
Backward search narrows the range of suffixes that begin with a pattern from its last symbol to its first.
"""

from __future__ import annotations

import numpy as np

DEPTH = 32


class _Bits:
    """A bit vector with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    def __init__(self, text: np.ndarray):
        """text: symbols from 0 (which no pattern contains) upward."""
        n, rank, reach = len(text), text.astype(np.int64), 1
        while reach < DEPTH:
            after = np.zeros(n, np.int64)
            after[: max(0, n - reach)] = rank[reach:] + 1
            rank = np.unique(rank * (n + text.max() + 2) + after, return_inverse=True)[1]
            reach *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        last = text[self.suffixes - 1]
        symbols = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels = []
        for level in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = ((last >> level) & 1).astype(np.uint8)
            self.levels.append((level, _Bits(bit)))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        every = np.arange(symbols)
        self.origin = self._down(every, np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.rank(place)
            place = np.where((symbol >> level) & 1, bits.zeros + ones, place - ones)
        return place

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns with one symbol more in front."""
        base = self.first[symbol] - self.origin[symbol]
        return base + self._down(symbol, low), base + self._down(symbol, high)

    def search(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of suffixes that begin with text[start : start + length], for every start."""
        tail = text[starts + length - 1]
        low, high = self.first[tail], self.first[tail + 1]
        for k in range(length - 2, -1, -1):
            low, high = self.step(text[starts + k], low, high)
        return low, high
