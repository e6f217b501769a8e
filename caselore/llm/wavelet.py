"""A wavelet matrix over small symbols: rank and select of many positions at a time, in numpy.

Each level holds one bit of every symbol, most significant first, and puts the zeros of the level before its ones. A rank
follows one symbol down the levels with two counts a level; the counts are kept per ``BLOCK`` bits and finished inside
the block from the packed bits.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class BitVector:
    """Bits with the number of ones before each block; ``rank`` counts the ones before a position."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros(-(-self.size // BLOCK) * BLOCK + BLOCK, bool)
        padded[:self.size] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at // BLOCK, (at % BLOCK).astype(np.uint64)
        inside = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.bits = len(symbols), bits
        self.levels: list[tuple[BitVector, int]] = []
        now = symbols
        for b in range(bits - 1, -1, -1):
            one = (now >> b) & 1 == 1
            self.levels.append((BitVector(one), self.size - int(one.sum())))
            now = np.concatenate([now[~one], now[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each of the positions."""
        begin, end = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for k, (vector, zeros) in enumerate(self.levels):
            b, e = vector.rank(begin), vector.rank(end)
            if (symbol >> (self.bits - 1 - k)) & 1:
                begin, end = zeros + b, zeros + e
            else:
                begin, end = begin - b, end - e
        return end - begin

    def rank_any(self, symbols, at: np.ndarray) -> np.ndarray:
        """Symbols of the set before each position: the sum of their ranks."""
        out = np.zeros(len(at), np.int64)
        for s in symbols:
            out += self.rank(s, at)
        return out

    def select_any(self, symbols, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least position in low..high before which there are ``count`` symbols of the set (high, if there are fewer), by
        bisection on the ranks, all positions at once."""
        low, high, count = (np.array(x, np.int64) for x in (low, high, count))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            enough = self.rank_any(symbols, middle) >= count[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1
