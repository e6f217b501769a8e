"""Sets of hashed five-word shingles and their min-wise sketches, over whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
SLOTS = 64
CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE = _stream(256, 1)
PLACE = _stream(WORDS, 2) | np.uint64(1)
TIMES = _stream(SLOTS, 3) | np.uint64(1)
PLUS = _stream(SLOTS, 4)
BASE = np.uint64(0x5851F42D4C957F2D)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(64)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts that lie in ``data`` one after the other, and the n + 1 offsets of each text's words.

    A word is a run of bytes other than 0x20 and 0x09 to 0x0D; A-Z count as a-z.
    """
    n, at, hashes, begins = int(starts[-1]), int(starts[0]), [], []
    while at < n:
        end = min(at + CHUNK, n)
        while end < n:  # never inside a word, or else at the end of a text
            ahead = data[end - 1:min(end + CHUNK, n)]
            blank = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
            border = starts[np.searchsorted(starts, end)]
            if len(blank):
                end = min(end + int(blank[0]), int(border))
                break
            end = min(min(end + CHUNK, n), int(border))
            if end == border:
                break
        d = data[at:end]
        solid = ~((d == 32) | ((d >= 9) & (d <= 13)))
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        borders = starts[np.searchsorted(starts, at):np.searchsorted(starts, end)] - at
        first[borders] = solid[borders]
        begin = np.flatnonzero(first)
        if len(begin):
            d = np.where((d >= 65) & (d <= 90), d + 32, d).astype(np.uint8)
            byte = np.flatnonzero(solid)
            word = np.cumsum(first)[byte] - 1
            place = byte - begin[word]
            longest = int(place.max()) + 1
            powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
            value = BYTE[d[byte]] * powers[place]
            hashes.append(_mix(np.add.reduceat(value, np.searchsorted(byte, begin))))
            begins.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of 1 to 4 words has one, a text without words none."""
    words, offsets = word_hashes(data, starts)
    if len(words) >= WORDS:
        run = words[:len(words) - WORDS + 1] * PLACE[0]
        for j in range(1, WORDS):
            run = run + words[j:len(words) - WORDS + 1 + j] * PLACE[j]
        run = _mix(run)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(run[a:b - WORDS + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * PLACE[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of the slots the least hash of a set, as 32-bit numbers."""
    least = None
    for a in range(0, len(shingles), 1024):
        part = ((shingles[a:a + 1024, None] * TIMES + PLUS) >> np.uint64(32)).min(0)
        least = part if least is None else np.minimum(least, part)
    return least.astype(np.uint32).view(np.int32)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
