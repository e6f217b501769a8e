"""Distinct hashed n-grams of a text, as indexes into a fixed range; numpy over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import utf8
from .shingles import word_hashes

PAIRS = 1 << 16
TRIPLES = 1 << 17
SHAPES = 1 << 13
QUALITY_SIZE = PAIRS + TRIPLES + SHAPES


def _distinct(index: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """Each value of ``index`` once, in linear time; ``stamp`` is scratch space over the whole range."""
    at = np.arange(len(index), dtype=np.int32)
    stamp[index] = at
    return index[stamp[index] == at]


def quality_ngrams(column: pa.Array):
    """For each text the indexes of its byte pairs and triples and of its pairs of word shapes.

    The shape of a word is its case, its last byte's kind, its length up to 7, and whether it repeats the word before.
    """
    data, starts = utf8(column)
    words, offsets = word_hashes(data, starts)
    stamp = np.zeros(QUALITY_SIZE, np.int32)
    for i in range(len(starts) - 1):
        d = data[starts[i]:starts[i + 1]].astype(np.int32)
        parts = []
        if len(d) > 1:
            pairs = d[:-1] * 256 + d[1:]
            parts.append(pairs)
            if len(d) > 2:
                triples = (pairs[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + d[2:].astype(np.uint32) * np.uint32(0x85EBCA77))
                parts.append(PAIRS + (triples >> np.uint32(15)).astype(np.int32))
        w = words[offsets[i]:offsets[i + 1]]
        if len(w):
            solid = ~((d == 32) | ((d >= 9) & (d <= 13)))
            first = np.flatnonzero(solid & np.r_[True, ~solid[:-1]])
            last = np.flatnonzero(solid & np.r_[~solid[1:], True])
            upper = np.cumsum(np.r_[0, (d >= 65) & (d <= 90)])
            capitals = upper[last + 1] - upper[first]
            size = last + 1 - first
            case = (capitals > 0).astype(np.int32) + (2 * capitals > size)
            end = d[last]
            kind = np.where((end >= 97) & (end <= 122) | (end >= 65) & (end <= 90) | (end >= 128), 0,
                            np.where((end == 46) | (end == 44), 1, np.where((end >= 48) & (end <= 57), 2, 3)))
            again = np.r_[False, w[1:] == w[:-1]]
            shape = (case * 4 + kind) * 2 + again
            size = np.minimum(size, 7)
            pair = np.r_[shape[:1] + 31 * 32, shape[1:] * 32 + shape[:-1]]
            parts += [PAIRS + TRIPLES + pair % 1024, PAIRS + TRIPLES + 1024 + shape * 8 + size]
        yield _distinct(np.concatenate(parts), stamp) if parts else np.zeros(0, np.int32)
