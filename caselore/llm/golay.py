"""Fuzzy keys from the binary Golay code: words of 23 bits that differ in at most two bits share a key.

The code's 4,096 codewords are the multiples of a polynomial, 12 free bits each, and every word lies within 3 bits of
exactly one of them. A word's keys are the codewords next to it and to the words one bit away: one codeword if the
word is within 2 bits of it, else six (its own and the five that are 4 bits away). Two words that differ in at most two
bits have a word within one bit of both, and that word's codeword is a key of each.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH = 23
FREE = 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
MOST_KEYS = 6


def _remainder(word: int) -> int:
    for k in range(LENGTH - 1, LENGTH - FREE - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - (LENGTH - FREE))
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the bytes at each of three places, and the error patterns (and how many) of each remainder."""
    by_byte = np.array([[_remainder((b << (8 * k)) & ((1 << LENGTH) - 1)) for b in range(256)] for k in range(3)], np.int32)
    bits = [1 << k for k in range(LENGTH)]
    patterns: list[list[int]] = [[] for _ in range(1 << (LENGTH - FREE))]
    for weight in range(5):
        for chosen in combinations(bits, weight):
            error = sum(chosen)
            of = patterns[_remainder(error)]
            if weight < 4 or of[0].bit_count() == 3:  # nearer words have no other codeword in reach
                of.append(error)
    count = np.array([len(p) for p in patterns])
    return by_byte, np.array([p + p[:1] * (MOST_KEYS - len(p)) for p in patterns], np.int32), count


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to six 12-bit keys of each 23-bit word (one row each), and how many of them count."""
    by_byte, patterns, count = tables()
    words = words.astype(np.int64)
    rest = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    return (words[:, None] ^ patterns[rest]) >> (LENGTH - FREE), count[rest]
