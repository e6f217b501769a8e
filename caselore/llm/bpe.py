"""Byte-pair vocabularies read from a public tokenizer file, and token counts of every prefix of a text."""

from __future__ import annotations

import itertools
import json

import ahocorasick
import numpy as np
import regex

# The word pattern of byte-level BPE and its contractions of two letters.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_letters() -> dict[str, int]:
    """Letter in the vocabulary file -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, ids in the order of the merges, and the special strings of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.ids = {bytes(letters[c] for c in word): i for word, i in file["model"]["vocab"].items()
                    if word not in self.special}
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.merges = [tuple(self.ids[bytes(letters[c] for c in side)] for side in m) for m in self.merges]
        self.size = 1 + max(max(self.ids.values()), *self.special.values(), 0)

    def encoder(self):
        """An encoder with these tokens; special strings inside a text give their id."""
        import tiktoken

        return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=self.ids, special_tokens=self.special)


class PrefixCounts:
    """Exact token counts of all prefixes of a text by dynamic programming.

    The last token of a prefix's encoding is the one token that ends there and may follow the last token of the
    prefix before it; so ``count[j] = count[j - len(token)] + 1``, word by word. Two tokens may be neighbours if
    merging their bytes together gives the two tokens again. Words met before are looked up.
    """

    def __init__(self, vocabulary: Vocabulary, most_words: int = 250_000):
        v = self.v = vocabulary
        self.words = regex.compile(WORDS)
        self.runs = regex.compile(r"(?<!\s)\s{2,}+(?=\S)")  # each run is tried once, from its begin
        self.special = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[int, int] = {}
        at = {i: b for b, i in v.ids.items()}
        for r, (a, b) in enumerate(v.merges):
            t = v.ids[at[a] + at[b]]
            if t not in self.rank:
                self.rank[t], self.parts[t] = r, (a, b)
            self.joined[a << 32 | b] = r
        self.ends = ahocorasick.Automaton()
        self.may_follow: list[dict[int, bool]] = [{} for _ in range(v.size)]
        self.pairs = 0
        self.stable: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_moves: dict[str, int] = {}
        self.most_words = most_words
        for word, t in v.ids.items():
            if self.whole(t):
                self.ends.add_word(word.decode("latin-1"), (t, len(word)))
        self.ends.make_automaton()

    def follows(self, a: int, b: int) -> bool:
        """True if the bytes of a and b together are encoded as a, b.

        Undo the merges inside both tokens, latest first; in each state the two tokens at the border must not have
        had a merge that came before the undone one. Of equal merges the left one happens first.
        """
        known = self.may_follow[a].get(b)
        if known is not None:
            return known
        pair = a, b
        rank, parts, joined = self.rank, self.parts, self.joined
        until, fine = 1 << 60, True
        while True:
            r = joined.get(a << 32 | b)
            if r is not None and r < until:
                fine = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                until, a = ra, parts[a][1]
            else:
                until, b = rb + 1, parts[b][0]
        self.pairs += 1
        if self.pairs > 2 * self.most_words:
            self.pairs = 0
            for known in self.may_follow:
                known.clear()
        self.may_follow[pair[0]][pair[1]] = fine
        return fine

    def whole(self, t: int) -> bool:
        """True if the token's own bytes are encoded as that token."""
        known = self.stable.get(t)
        if known is None:
            p = self.parts.get(t)
            known = self.stable[t] = p is None or self.whole(p[0]) and self.whole(p[1]) and self.follows_before(p, t)
        return known

    def follows_before(self, pair: tuple[int, int], t: int) -> bool:
        """True if the two parts of t come to stand side by side before their merge to t."""
        (a, b), rank, parts, joined = pair, self.rank, self.parts, self.joined
        until, first = self.rank[t] + 1, True
        while True:
            r = joined.get(a << 32 | b)
            if not first and r is not None and r < until:
                return False
            first = False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = ra, parts[a][1]
            else:
                until, b = rb + 1, parts[b][0]

    def of_word(self, raw: bytes) -> list[int]:
        """Counts of the prefixes of one word, byte by byte."""
        follows, may = self.follows, self.may_follow
        last, count = [-1], [0]
        for end, (t, size) in self.ends.iter(raw.decode("latin-1")):  # by end, the longest first
            if end < len(last) - 1:
                continue
            k = end + 1 - size
            if k:
                before = last[k]
                fine = may[before].get(t)
                if not (follows(before, t) if fine is None else fine):
                    continue
            last.append(t)
            count.append(count[k] + 1)
        if len(last) != len(raw) + 1:
            raise ValueError(f"not every prefix of {raw[:80]!r} has an encoding")
        return count

    def steps(self, word: str) -> bytes:
        """The change of the count with each character, as signed bytes."""
        known = self.known.get(word)
        if known is not None:
            return known
        if word.isascii():
            counts = self.of_word(word.encode())
        else:
            raw = word.encode()
            by_byte = self.of_word(raw)
            ends = [j for j in range(1, len(raw) + 1) if j == len(raw) or raw[j] & 0xC0 != 0x80]
            counts = [0] + [by_byte[j] for j in ends]
        if word in LONG_CONTRACTIONS:  # without its second letter the pattern takes the mark and the letter apart
            counts[2] = counts[1] + 1
        out = bytes([(b - a) & 255 for a, b in itertools.pairwise(counts)])
        if len(word) <= 64:
            if len(self.known) >= self.most_words:
                self.known.clear()
            self.known[word] = out
        return out

    def plain(self, text: str) -> np.ndarray:
        """Changes of the count over a text without special strings, one for each character."""
        get, steps = self.known.get, self.steps
        out = np.frombuffer(b"".join([get(w) or steps(w) for w in self.words.findall(text)]), np.int8)
        moved = None
        for m in self.runs.finditer(text):
            run, end = m.group(), m.end()
            # a prefix that ends with the run has it as one word; with the next character the last blank leaves it
            d = self.known_moves.get(run)
            if d is None:
                whole, front, last = (int(np.frombuffer(steps(x), np.int8).sum(dtype=np.int64)) for x in (run, run[:-1], run[-1]))
                d = whole - front - last
                if len(run) <= 64 and len(self.known_moves) < self.most_words:
                    self.known_moves[run] = d
            if d:
                if moved is None:
                    moved = out.copy()
                moved[end - 1] += d
                moved[end] -= d
        return out if moved is None else moved

    def changes(self, text: str) -> np.ndarray:
        """Changes of the token count, one for each character; their sum is the count of the whole text."""
        if not text:
            return np.zeros(0, np.int8)
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            run = self.plain(text[at:m.end() - 1])  # inside the special string it is still ordinary text
            before = int(run[:m.start() - at].sum(dtype=np.int64))
            out += [run, np.array([before + 1 - int(run.sum(dtype=np.int64))], np.int64)]
            at = m.end()
        out.append(self.plain(text[at:]) if at < len(text) else np.zeros(0, np.int8))
        joined = np.concatenate([x.astype(np.int64) for x in out])
        if len(joined) and (joined.min() < -128 or joined.max() > 127):
            return joined
        return joined.astype(np.int8)
