"""Fill-in-the-middle documents: prefix, middle and suffix at unit boundaries found through a wavelet matrix.

The bytes of a buffer of texts become character classes (line end, blank, letter, digit, sentence mark, other, continuation
byte), each with a flag that says whether a blank or the text's end follows. One wavelet matrix holds them. The units of a
text (lines, words or sentences) end at some of these symbols, so the number of ends before a position is a sum of ranks;
``n`` is the number between a text's borders, one more if its last stretch has no end, and the two cuts are found by
bisection on the ranks. Numbers of code points are ranks of the continuation bytes.

Which boundaries become cuts is decided by the sha256 of seed and id, so the same document is cut alike wherever it lies.

Defined results: a null text is an empty one; an empty text, and one that holds a sentinel, stays as it is (``plain``); a text
of one unit can be wholly prefix, middle or suffix; a null id counts as an empty string; repeated rows give
repeated rows; texts of any length are cut as a whole; other columns are not read. No row meets another, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, utf8
from .wavelet import WaveletMatrix

LINE_END, BLANK, LETTER, DIGIT, SENTENCE_MARK, OTHER, CONTINUATION = range(7)
ENDS_WORD = 8  # the flag: a blank or the text's end follows
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 11, 12, 13, 32]] = BLANK
CLASS[10] = LINE_END
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[48:58] = DIGIT
CLASS[[33, 46, 63]] = SENTENCE_MARK
CLASS[128:192] = CONTINUATION
CLASS[192:] = LETTER
UNIT_ENDS = {  # the symbols that close a unit
    "line": (LINE_END, LINE_END + ENDS_WORD),
    "word": tuple(c + ENDS_WORD for c in (LETTER, DIGIT, SENTENCE_MARK, OTHER, CONTINUATION)),
    "sentence": (SENTENCE_MARK + ENDS_WORD, LINE_END, LINE_END + ENDS_WORD),
}
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
SLICE = 1 << 20


def symbols(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class and flag of every byte of the texts in the buffer; ``starts`` counts from the buffer's begin."""
    kinds = CLASS[data]
    blank = kinds <= BLANK
    follows = np.r_[blank[1:], True] if len(kinds) else blank
    last = starts[1:][np.diff(starts) > 0] - 1
    follows[last] = True
    return kinds + follows.astype(np.uint8) * np.uint8(ENDS_WORD)


class Boundaries:
    """Unit boundaries and code points of the texts of one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, unit: str = "line"):
        self.begin, self.end = starts[:-1], starts[1:]
        found = symbols(data, starts)
        self.matrix, self.ends = WaveletMatrix(found, 4), UNIT_ENDS[unit]
        self.before = self.matrix.rank_any(self.ends, self.begin)
        self.closed = self.matrix.rank_any(self.ends, self.end) - self.before
        last = np.maximum(self.end - 1, 0)
        filled = self.end > self.begin
        open_ = filled.copy()
        if len(found):
            open_[filled] = ~np.isin(found[last[filled]], self.ends)
        self.n = self.closed + open_

    def locate(self, text: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The position in the buffer after the first ``units`` units of each text."""
        found = self.matrix.select_any(self.ends, self.before[text] + units, self.begin[text], self.end[text])
        return np.where(units >= self.n[text], self.end[text], found)

    def code_points(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        inner = (CONTINUATION, CONTINUATION + ENDS_WORD)
        return high - low - (self.matrix.rank_any(inner, high) - self.matrix.rank_any(inner, low))


def drawn(seed: int, key) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[k:k + 8], 16) for k in range(0, 32, 8))


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = (SENTINELS[k].encode() for k in ("prefix", "suffix", "middle"))
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restored(output: str, form: str) -> str:
    """The text that ``output`` was made from."""
    if form == "plain":
        return output
    p, s, m = (SENTINELS[k] for k in ("prefix", "suffix", "middle"))
    one, two = (p, s) if form == "psm" else (s, p)
    first, rest = output[len(one):].split(two, 1)
    second, middle = rest.split(m, 1)
    return first + middle + second if form == "psm" else second + middle + first


def transform(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = "line", seed: int = 7,
              rate: int = 100, spm: int = 50) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars and output of every row.

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of them with the suffix first.
    """
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    marks = [m.encode() for m in SENTINELS.values()]

    def run(batches):
        for part in slices(batches, 1, SLICE):
            data, starts = utf8(part.column(1))
            data, starts = data[starts[0]:starts[-1]], starts - starts[0]
            raw = data.tobytes()
            at = Boundaries(data, starts, unit)
            ids = part.column(0).to_pylist()
            draws = [drawn(seed, key) for key in ids]
            texts = [raw[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            form = ["plain" if not t or h[2] % 100 >= rate or any(m in t for m in marks) else "spm" if h[3] % 100 < spm else "psm"
                    for t, h in zip(texts, draws, strict=True)]
            cut = np.flatnonzero([f != "plain" for f in form])
            pair = np.array([[draws[i][0] % (int(at.n[i]) + 1), draws[i][1] % (int(at.n[i]) + 1)] for i in cut], np.int64).reshape(-1, 2)
            first, second = at.locate(cut, pair.min(1)), at.locate(cut, pair.max(1))
            sizes = [[None] * len(ids), [None] * len(ids)]
            for size, low, high in ((sizes[0], at.begin[cut], first), (sizes[1], first, second)):
                for i, chars in zip(cut, at.code_points(low, high).tolist(), strict=True):
                    size[i] = chars
            for i, a, b in zip(cut, first, second, strict=True):
                texts[i] = joined(form[i], raw[starts[i]:a], raw[a:b], raw[b:starts[i + 1]])
            yield [part.column(0), pa.array(at.n), pa.array(form), pa.array(sizes[0], pa.int64()), pa.array(sizes[1], pa.int64()),
                   pa.array([t.decode() for t in texts], pa.string())]

    return arrow_map(rows, run, f"`{id_column}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def digests(transformed: DataFrame) -> DataFrame:
    """The hashes of the output and of the text restored from it, in place of the output."""
    names = [c for c in transformed.columns if c not in ("form", "output")]
    fields = ", ".join(f"`{c}` {transformed.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for part in slices(batches, len(names) + 1, SLICE):
            form, output = part.column(len(names)), part.column(len(names) + 1).to_pylist()
            back = [restored(o, f) for o, f in zip(output, form.to_pylist(), strict=True)]
            yield [*part.columns[:len(names)], form, *[pa.array([hashlib.sha256(x.encode()).hexdigest() for x in of], pa.string())
                                                       for of in (output, back)]]

    return arrow_map(transformed.select(*names, "form", "output"), run,
                     f"{fields}, form string, output_sha256 string, restored_sha256 string")
