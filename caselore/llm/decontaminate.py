"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Both sides are compared as bytes, A-Z as a-z and every blank as a space, so offsets are those of the UTF-8 text. An item
is looked for in windows of ``WINDOW`` bytes from every byte on (a shorter item as a whole). A text region within ``e`` edits of a window of length n has at least n + 1 - q (e + 1) of its q-grams, on at most 2 e + 1 neighbouring
diagonals; so q-gram hits are counted in bands of 32 diagonals that overlap by half, and only regions that reach the
bound are aligned, inside their band. The budget is 7 edits in 100 bytes, so a passage of 93 bytes or more of an item is
found wherever it starts (the missing bytes of a window count as edits; of an item below 100 bytes, 7 in 100 may be missing).

The benchmark is measured first and shipped in parts of at most ``PART_BYTES``; a larger one takes several passes.

Memory is bounded for any text: hits are expanded ``HITS`` at a time at most. Where a stretch of text and the items have
more in common (repeated markup against a periodic item), the stretch is halved, with an overlap that holds a whole
match; a short stretch is compared with the items a slice at a time, and long items are divided into overlapping
segments, so that the smallest piece of work is one stretch against one segment. No q-gram is left out.

Defined results: null texts and items are empty; items shorter than q bytes cannot match; repeated items match each;
texts of any length are read whole, in overlapping chunks; repeated rows and ids give their matches each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import arrow_map, column, free_name, slices, utf8

Q = 10
WINDOW = 100
STEP = 25
EDITS = 7  # in 100 bytes
BAND = 16  # half a band; two of them hold the 2 e + 1 diagonals of a match
CHUNK = 1 << 20
PART_BYTES = 8 << 20
ALIGNED = 4096  # windows aligned at a time
HITS = 1 << 20
SEGMENT = 1024  # bytes of an item, and of the shortest stretch of text that is not halved
OVERLAP = WINDOW + 4 * BAND

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32


def _codes(d: np.ndarray) -> np.ndarray:
    """A hash of the q bytes from each position on."""
    n = len(d) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    d = np.ascontiguousarray(d)
    eight = np.ndarray((len(d) - 7,), "<u8", d, 0, (1,)).astype(np.uint64)
    return (eight[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[Q - 8:Q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x94D049BB133111EB) >> np.uint64(42)).astype(np.int64)


def distances(window: np.ndarray, region: np.ndarray, free_start: bool = True) -> np.ndarray:
    """Fewest edits between the window and any stretch of the region, by the stretch's end; it may start anywhere or at 0."""
    place = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64) if free_start else place.copy()
    for i, c in enumerate(window):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (region != c), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    return row


def align_bands(windows: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, edits) of the best stretch of each row of regions for the window in the same row, by diagonals: the stretch
    begins and stays on diagonals 0 to width - 1, where the regions are width - 1 bytes longer than the windows. A cell holds
    the edits and the first begin that reaches them."""
    n = windows.shape[1]
    width = regions.shape[1] - n + 1
    step = np.int16(1 << int(width).bit_length())
    slope = np.arange(width, dtype=np.int16) * step
    row = np.repeat(np.arange(width, dtype=np.int16)[None], len(windows), axis=0)
    for i in range(n):
        new = row + (regions[:, i:i + width] != windows[:, i:i + 1]) * step
        np.minimum(new[:, :-1], row[:, 1:] + step, out=new[:, :-1])
        new -= slope
        row = np.minimum.accumulate(new, axis=1)
        row += slope
    edits = row // step
    last = edits.argmin(axis=1)
    every = np.arange(len(row))
    return (row[every, last] % step).astype(np.int64), last + n, edits[every, last].astype(np.int64)


def align(window: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """(begin, end, edits) of the best stretch of the region, if it is within the budget."""
    raw, want = region.tobytes(), window.tobytes()
    at = raw.find(want)
    if at >= 0:
        return at, at + len(window), 0
    row = distances(window, region)
    end = int(row.argmin())
    if row[end] > edits:
        return None
    back = distances(window[::-1], region[:end][::-1], free_start=False)
    return end - int(np.flatnonzero(back == row[end])[-1]), end, int(row[end])


def segments(b: np.ndarray) -> list[np.ndarray]:
    """The item in overlapping segments; every window of it lies in one."""
    step = SEGMENT - WINDOW + 1
    return [b[k:k + SEGMENT] for k in range(0, max(len(b) - WINDOW + 1, 1), step)] if len(b) > SEGMENT else [b]


class Index:
    """The q-grams of some items, sorted, with a bitmap in front."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        cut = [segments(_PLAIN[np.frombuffer((t or "").encode(), np.uint8)]) for _, t in items]
        self.bytes = [b for of in cut for b in of]
        self.owner = np.repeat(np.arange(len(items)), [len(of) for of in cut]).tolist()
        codes = [_codes(b) for b in self.bytes]
        every = np.concatenate([*codes, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(self.bytes), dtype=np.int32), [len(c) for c in codes])[order]
        self.place = np.concatenate([*[np.arange(len(c), dtype=np.int32) for c in codes], np.zeros(0, np.int32)])[order]
        self.codes, self.first = np.unique(every[order], return_index=True)
        self.count = np.diff(np.r_[self.first, len(every)])
        self.known = np.zeros(1 << 22, bool)
        self.known[_slot(self.codes)] = True
        # (every STEP-th start, bytes, edits, bound) of the windows; find tries all starts, the tests' plain search only these
        self.windows, self.least = [], np.full(len(self.bytes), 1 << 30)
        for k, b in enumerate(self.bytes):
            n = min(WINDOW, len(b))
            starts = sorted({*range(0, len(b) - n + 1, STEP), len(b) - n}) if n >= Q else []
            edits = min(n * EDITS // 100, (n + 1 - Q) // Q)
            bound = max(1, n + 1 - Q * (edits + 1))
            self.windows.append((starts, n, edits, bound))
            if starts:
                self.least[k] = bound
        self.reach = max([len(b) for b in self.bytes], default=0)

    def find(self, data: np.ndarray, starts: np.ndarray):
        """(text, item, begin, end, edits) of every merged match in the texts of a buffer."""
        first = 0
        while first < len(starts) - 1:
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK, side="right")) - 1)
            if last == first + 1:  # perhaps a long text: in chunks
                found, at, end = [], int(starts[first]), int(starts[last])
                while at < end:
                    stop = min(at + CHUNK, end)
                    found = merged(found + [(0, k, b + at - int(starts[first]), e + at - int(starts[first]), x)
                                            for _, k, b, e, x in self._chunk(data[at:stop], np.array([0, stop - at]))])
                    if stop == end:
                        break
                    at = stop - OVERLAP
            else:
                found = self._chunk(data[starts[first]:starts[last]], starts[first:last + 1] - starts[first])
            yield from ((first + d, *rest) for d, *rest in merged(found))
            first = last

    def _chunk(self, data: np.ndarray, starts: np.ndarray) -> list[tuple]:
        d = _PLAIN[data]
        codes = _codes(d)
        at = np.flatnonzero(self.known[_slot(codes)])
        if not len(at) or not len(self.codes):
            return []
        k = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        text = np.searchsorted(starts, at, side="right") - 1
        real = (self.codes[k] == codes[at]) & (at + Q <= starts[text + 1])
        return self._stretch(d, starts, at[real], k[real], text[real])

    def _stretch(self, d: np.ndarray, starts: np.ndarray, at: np.ndarray, k: np.ndarray, text: np.ndarray) -> list[tuple]:
        """Matches of the q-grams at some places (sorted), with at most HITS hits in memory."""
        if not len(at):
            return []
        if self.count[k].sum() > HITS and at[-1] - at[0] > 2 * SEGMENT:
            middle = int(at[0] + at[-1]) // 2
            left, right = np.searchsorted(at, [middle + OVERLAP, middle])
            halves = slice(0, left), slice(right, None)
            return merged([m for part in halves for m in self._stretch(d, starts, at[part], k[part], text[part])])
        if self.count[k].sum() <= HITS:
            return merged(self._bands(d, starts, at, text, self.first[k], self.count[k]))
        # a short stretch against as many items as HITS allow; one at least
        distinct, of = np.unique(k, return_inverse=True)
        items = [self.item[self.first[c]:self.first[c] + self.count[c]] for c in distinct]  # sorted, each
        hits = np.zeros(len(self.bytes), np.int64)
        for some, weight in zip(items, np.bincount(of), strict=True):
            np.add.at(hits, some, weight)
        found, low, total = [], 0, np.cumsum(hits)
        while low < len(hits):
            before = int(total[low - 1]) if low else 0
            high = max(int(np.searchsorted(total, before + HITS, side="right")), low + 1)
            range_ = np.array([np.searchsorted(some, [low, high]) for some in items])
            begin, times = self.first[distinct] + range_[:, 0], range_[:, 1] - range_[:, 0]
            some = np.flatnonzero(times[of])
            if len(some):
                found = merged(found + self._bands(d, starts, at[some], text[some], begin[of[some]], times[of[some]]))
            low = high
        return found

    def _bands(self, d: np.ndarray, starts: np.ndarray, at: np.ndarray, text: np.ndarray, begin: np.ndarray, times: np.ndarray) -> list[tuple]:
        """Matches of the hits: ``times`` ones from ``begin`` on for each place."""
        hit = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())
        at, text = np.repeat(at, times), np.repeat(text, times)
        item, place = self.item[hit].astype(np.int64), self.place[hit].astype(np.int64)
        diagonal = at - starts[text] - place + self.reach + 2 * BAND
        out, todo = [], {}
        for half in (0, 1):
            band = (diagonal + half * BAND) // (2 * BAND)
            key = (text << 46) | (item << 26) | band
            order = np.argsort(key, kind="stable")
            key_s = key[order]
            begin = np.flatnonzero(np.r_[True, key_s[1:] != key_s[:-1]])
            size = np.diff(np.r_[begin, len(key_s)])
            enough = size >= self.least[item[order[begin]]]
            for b, n in zip(begin[enough], size[enough], strict=True):
                rows = order[b:b + n]
                i, t = int(item[rows[0]]), int(text[rows[0]])
                places = np.unique(place[rows])
                low = (2 * int(band[rows[0]]) - half) * BAND - self.reach - 2 * BAND
                _, length, edits, bound = self.windows[i]
                item_bytes, first, size_t = self.bytes[i], int(starts[t]), int(starts[t + 1] - starts[t])
                upto = np.searchsorted(places, np.arange(len(item_bytes) + 1))
                count = len(item_bytes) - length + 1
                left = upto[length - Q + 1:length - Q + 1 + count] - upto[:count] >= bound
                lines, times = np.unique(at[rows] - first - place[rows], return_counts=True)
                for line in lines[times > length - Q]:  # a verbatim window has all its q-grams on one diagonal
                    if not left.any():
                        break
                    x, y = max(0, -int(line)), min(len(item_bytes), size_t - int(line))
                    if y - x < length:
                        continue
                    same = np.r_[0, np.cumsum(item_bytes[x:y] == d[first + x + line:first + y + line])]
                    whole = np.flatnonzero((same[length:] - same[:-length] == length) & left[x:y - length + 1]) + x
                    left[whole] = False
                    for run in np.split(whole, np.flatnonzero(np.diff(whole) > 1) + 1) if len(whole) else ():
                        out.append((t, i, int(run[0] + line), int(run[-1] + line) + length, 0))
                at_s = np.flatnonzero(left)
                if len(at_s):
                    todo.setdefault((length, edits), []).append((t, i, low - edits, at_s))
        for (length, edits), groups in todo.items():
            out += self._aligned(d, starts, length, edits, groups)
        return [(t, self.owner[i], b, e, x) for t, i, b, e, x in out]

    def _aligned(self, d: np.ndarray, starts: np.ndarray, length: int, edits: int, groups: list[tuple]):
        """Matches of the windows (text, item, lowest diagonal, starts in the item) that share a length."""
        t, i, low = (np.repeat([g[c] for g in groups], [len(g[3]) for g in groups]) for c in range(3))
        s = np.concatenate([g[3] for g in groups])
        for k in range(0, len(s), ALIGNED):
            part = slice(k, k + ALIGNED)
            windows = np.stack([self.bytes[x][y:y + length] for x, y in zip(i[part], s[part], strict=True)])
            begin = (s + low)[part]
            size = (starts[t + 1] - starts[t])[part]
            at = begin[:, None] + np.arange(length + 2 * BAND + 2 * edits - 1)
            outside = (at < 0) | (at >= size[:, None])
            at += starts[t[part]][:, None]
            regions = d[np.clip(at, 0, len(d) - 1)]
            regions[outside] = 255  # in no text
            b, e, x = align_bands(windows, regions)
            b, e = np.maximum(begin + b, 0), np.minimum(begin + e, size)
            good = (x <= edits) & (b < e)
            yield from zip(*(c[good].tolist() for c in (t[part], i[part], b, e, x)), strict=True)


def merged(found: list[tuple]) -> list[tuple]:
    """Overlapping stretches of one text and item put together; the edits are those of the worst window."""
    out: list[list] = []
    for t, i, b, e, x in sorted(set(found)):
        if out and out[-1][0] == t and out[-1][1] == i and b <= out[-1][3]:
            out[-1][3], out[-1][4] = max(e, out[-1][3]), max(x, out[-1][4])
        else:
            out.append([t, i, b, e, x])
    return [tuple(x) for x in out]


def parts(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", part_bytes: int = PART_BYTES):
    """Lists of items (id, text) of bounded size each."""
    b = benchmark.select(F.col(item_column).alias("item"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    n = -(-(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes) or 1
    for k in range(n):
        part = b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in part.orderBy("item", "text").collect()]


def matches(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            item_column: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """id, item, begin, end (bytes) and edits of every stretch of a text that comes from an item."""
    kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((df, id_column), (benchmark, item_column)))
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = None
    for items in parts(benchmark, item_column, item_text, part_bytes):
        index = Index(items)

        def run(batches, index=index):
            for part in slices(batches, 1):
                found = list(index.find(*utf8(part.column(1))))
                yield [part.column(0).take(pa.array([f[0] for f in found], pa.int32())), pa.array([index.ids[f[1]] for f in found]),
                       *[pa.array([f[c] for f in found], pa.int64()) for c in (2, 3, 4)]]

        here = arrow_map(rows, run, f"`{id_column}` {kind}, `{item_column}` {item_kind}, `begin` long, `end` long, edits long")
        out = here if out is None else out.unionByName(here)
    return out


def mark(df: DataFrame, benchmark: DataFrame, text_column: str = "text", name: str = "leaked", item_column: str = "item_id",
         item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``df``, whatever their columns, and whether the text holds a stretch of any item."""
    if name in df.columns:
        raise ValueError(f"the table has a column {name} already; choose another name")
    last, out = len(df.columns), df.select("*", F.lit(False).alias(name))
    kinds, text = StructType([*df.schema.fields, StructField(name, BooleanType())]), free_name("text_to_search", df)
    for items in parts(benchmark, item_column, item_text, part_bytes):
        index = Index(items)

        def run(batches, index=index):
            for part in slices(batches, last + 1):
                leaked = np.array(part.column(last).to_pylist(), bool)
                leaked[[f[0] for f in index.find(*utf8(part.column(last + 1)))]] = True
                yield [*part.columns[:last], pa.array(leaked)]

        out = arrow_map(out.select("*", F.coalesce(column(text_column), F.lit("")).alias(text)), run, kinds)
    return out
