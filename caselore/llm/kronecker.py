"""Exact inner products of integer vectors, several at a time: candidates' components packed into fields of one wide integer.

Both sides are biased until no component is negative. The biased components of one position of several candidates then
go into separate fields of one integer, wide enough for the whole sum, so that one multiplication with an anchor's
biased component multiplies all of them and no field runs over into the next. Summed over the positions, the fields are
the biased inner products; taking the bias out again gives the exact ones.

The wide integers are 64-bit machine words where at least two fields fit into one (64 positions of 9-bit components need
24 bits a field), else Python's integers of any size.
"""

from __future__ import annotations

import numpy as np

LOOSE_FIELDS = 16  # fields of an integer of any size


class Packed:
    """Candidates (rows of a matrix of integers) ready to be multiplied with anchors whose components reach from low to high."""

    def __init__(self, candidates: np.ndarray, low: int, high: int):
        self.n, self.dim = candidates.shape
        self.bias_c = -int(candidates.min(initial=0))
        self.bias_a = -min(int(low), 0)
        most = (int(candidates.max(initial=0)) + self.bias_c) * (max(int(high), 0) + self.bias_a) * max(self.dim, 1)
        self.width = max(most.bit_length(), 1)
        self.fields = 64 // self.width
        self.words = self.fields >= 2
        if not self.words:
            self.fields = LOOSE_FIELDS
        rows = -(-self.n // self.fields) if self.n else 0
        kind = np.uint64 if self.words else object
        padded = np.zeros((rows * self.fields, self.dim), kind)
        if self.words:
            padded[:self.n] = (candidates + self.bias_c).astype(np.uint64)
        else:
            padded[:self.n] = candidates.astype(object) + self.bias_c
        by_field = padded.reshape(rows, self.fields, self.dim)
        self.packed = np.zeros((rows, self.dim), kind)
        for f in range(self.fields):
            shift = np.uint64(f * self.width) if self.words else f * self.width
            self.packed += by_field[:, f] << shift
        self.packed = np.ascontiguousarray(self.packed.T)  # one row for each position
        total = candidates.astype(kind if self.words else object).sum(1) if self.words else [sum(map(int, c)) for c in candidates]
        self.sums = np.array(total, np.int64 if self.words else object)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The inner product of the anchor with each candidate (64-bit; of any size where machine words do not suffice)."""
        biased = [int(a) + self.bias_a for a in anchor]
        wide = np.zeros(self.packed.shape[1], self.packed.dtype)
        if self.words:
            product = np.empty_like(wide)
            for row, a in zip(self.packed, biased, strict=True):  # one multiplication for all fields of a word
                np.multiply(row, np.uint64(a), out=product)
                wide += product
            mask = np.uint64((1 << self.width) - 1)
            fields = [((wide >> np.uint64(f * self.width)) & mask).astype(np.int64) for f in range(self.fields)]
        else:
            for row, a in zip(self.packed, biased, strict=True):
                wide = wide + row * a
            mask = (1 << self.width) - 1
            fields = [(wide >> (f * self.width)) & mask for f in range(self.fields)]
        out = np.stack(fields, 1).reshape(-1)[:self.n] if self.n else np.zeros(0, np.int64)
        plain = sum(int(a) for a in anchor)
        # sum (a + A)(c + C) = sum ac + C sum a + A sum c + dim A C
        return out - (self.bias_c * plain + self.dim * self.bias_a * self.bias_c) - self.bias_a * self.sums
