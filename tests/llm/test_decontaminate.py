"""Decontamination against a plain search over all windows and texts."""

import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselore.llm import decontaminate as D


def plain_distance(window, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=20))
def test_alignment(window, text):
    w, t = (np.frombuffer(x.encode(), np.uint8) for x in (window, text))
    want = plain_distance(window, text)
    assert D.distances(w, t).min() == want
    got = D.align(w, t, want)
    assert got[2] == want and D.distances(w, t[got[0]:got[1]], free_start=False)[-1] == want
    assert want == 0 or D.align(w, t, want - 1) is None


def material(seed=1):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(["the", "thnt", "er", "ing", "ation", "hea", "nd"]) + rng.choice(["re", "st", "on", ""])
                               for _ in range(n))
    items = [prose(rng.randint(20, 60)) for _ in range(12)] + ["short one here only", "tiny", "", None]
    def edited(s, n):
        s = list(s)
        for _ in range(n):
            p = rng.randrange(len(s))
            s[p:p + 1] = rng.choice([[], ["x"], [s[p], "y"]])
        return "".join(s)
    docs = []
    for k in range(60):
        body = prose(rng.randint(5, 120))
        item = items[rng.randrange(12)]
        kind = k % 6
        if kind == 1:
            body += "\n" + item + " " + prose(10)
        elif kind == 2:
            body += " " + edited(item, len(item) // 20).upper()
        elif kind == 3:
            body = item[20:150].replace(" ", "\n")
        elif kind == 4:
            body += item[:60]
        elif kind == 5:
            body += edited(item, len(item) // 8)
        docs.append(body)
    return items, docs + [None, "", "Éé " + items[0] + " ñ", "so this is SHORT one here only yes", "w " * 30_000 + items[1] + " w" * 30_000]


def plain(items, docs):
    out = set()
    for k, item in enumerate(items):
        b = bytes(D._PLAIN[np.frombuffer((item or "").encode(), np.uint8)])
        starts, n, edits, _ = D.Index([(0, item)]).windows[0]
        for d, text in enumerate(docs):
            t = bytes(D._PLAIN[np.frombuffer((text or "").encode(), np.uint8)])
            near = lambda w: w in t or len(t) < 3000 and plain_distance(w, t) <= edits
            if any(near(b[s:s + n]) for s in starts):
                out.add((d, k))
    return out


def test_against_plain_search(spark):
    items, docs = material()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id string, end int").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = plain(items, docs)
    got = D.matches(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 30
    for r in got:
        assert 0 <= r.begin < r.end <= len(docs[r.doc_id].encode())
    r = next(r for r in got if r.doc_id == 62 and r.item_id == 0)
    assert docs[62].encode()[r.begin:r.end].decode() == items[0] and r.edits == 0
    assert {(r.doc_id, r.item_id) for r in D.matches(df, bench, part_bytes=600).collect()} == want
    leaked = {r.doc_id for r in D.mark(df, bench, part_bytes=900).where("leaked").collect()}
    assert leaked == {d for d, _ in want}


def test_chunks(monkeypatch):
    items, docs = material(7)
    index = D.Index(list(enumerate(items)))
    raw = [(t or "").encode() for t in docs]
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    whole = {f[:2] for f in index.find(data, starts)}
    monkeypatch.setattr(D, "CHUNK", 400)
    assert {f[:2] for f in index.find(data, starts)} == whole


def test_empty(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(df, none).collect() == [] and D.mark(df, none).first().leaked is False
    assert D.matches(df.where("doc_id > 3"), df.withColumnRenamed("doc_id", "item_id")).collect() == []


def alternating(item, every):
    """The item with a byte put in and one taken out in turn, so that its diagonal goes back and forth by one."""
    out = []
    for k, c in enumerate(item):
        turn = (k + 1) % every == 0 and (k + 1) // every
        out.append("#" + c if turn and turn % 2 else "" if turn else c)
    return "".join(out)


def test_bands_overlap():
    rng = random.Random(5)
    for every in (13, 14, 15):
        item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(130))
        copy = alternating(item, every)
        index = D.Index([(0, item)])
        starts, n, edits, _ = index.windows[0]
        assert min(plain_distance(item[s:s + n], copy) for s in starts) <= edits
        for shift in range(2 * D.BAND):
            text = ("~" * (40 + shift) + copy + "~" * 40).encode()
            found = list(index.find(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
            assert len(found) == 1 and found[0][2] >= 35 + shift and found[0][4] <= edits, (every, shift)


def one_buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]


def test_passages_from_any_byte():
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(240))
    index = D.Index([(0, item)])
    for n in (93, 100):
        texts = ["~" * (s % 7) + item[s:s + n] + "~" * (s % 5) for s in range(len(item) - n + 1)]
        found = {t: (b, e, x) for t, _, b, e, x in index.find(*one_buffer(texts))}
        assert len(found) == len(texts)
        assert n < 100 or all(found[t][2] <= 7 and found[t][1] - found[t][0] >= 93 for t in found)


def test_every_window_against_plain_alignment():
    rng = random.Random(11)
    items, docs = material(11)
    items, docs = [x for x in items[:5]], [x for x in docs[:60] if x][:30]
    for item in items:  # pieces at odd places, with edits
        a = rng.randrange(len(item) // 3)
        docs.append("q " * 9 + alternating(item[a:a + 105], 15) + " zz" * 9)
    items += ["short one here only"]
    want = set()
    for k, item in enumerate(items):
        b = D._PLAIN[np.frombuffer(item.encode(), np.uint8)]
        _, n, edits, bound = D.Index([(0, item)]).windows[0]
        for d, text in enumerate(docs):
            t = D._PLAIN[np.frombuffer(text.encode(), np.uint8)]
            if any(D.distances(b[s:s + n], t).min() <= edits for s in range(0, len(b) - n + 1)):
                want.add((d, k))
    got = list(D.Index(list(enumerate(items))).find(*one_buffer(docs)))
    assert {f[:2] for f in got} == want and len(want) > 5
    assert all(0 <= b < e <= len(docs[d].encode()) for d, _, b, e, _ in got)


def test_band_alignment():
    rng = np.random.default_rng(2)
    windows = rng.integers(97, 100, (200, 12)).astype(np.uint8)
    regions = rng.integers(97, 100, (200, 12 + 40)).astype(np.uint8)
    regions[:, :12] = regions[:, 40:] = 255  # so that the best stretch stays on the diagonals
    for w, r, *got in zip(windows, regions, *D.align_bands(windows, regions), strict=True):
        begin, end, edits = map(int, got)
        assert edits == D.distances(w, r).min()
        assert edits == D.distances(w, r[begin:end], free_start=False)[-1]


@pytest.mark.parametrize("unit", ["ab ", "a", " ", "\n\t", "abcdefghijkl"])
def test_periodic_text_in_bounded_memory(unit, monkeypatch):
    """A short period against an item of the same period: one match over all of it; memory does not grow with the text."""
    item, text = (unit * 200)[:180], (unit * 30_000)[:30_000]
    monkeypatch.setattr(D, "HITS", 1 << 16)
    index = D.Index([(0, "nothing of the kind is to be found in any of the texts of this test, whatever their length is"), (7, item)])
    tracemalloc.start()
    found = list(index.find(*one_buffer(["x" * 50, text, "y " * 50])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[:4] for f in found] == [(1, 1, 0, len(text))] and found[0][4] <= 7 and peak < 80 << 20


def test_slices_change_nothing(monkeypatch, hits=2000):
    """The same matches however little may be in memory, with items that are periodic, long, and many."""
    rng = random.Random(8)
    items, docs = material(8)
    items = [*items[:20], "ab " * 60, "a" * 150, "ab" * 1000, "".join(rng.choice("abc ") for _ in range(5000))]
    docs = [x for x in docs[:40] if x] + ["ab " * 500, "a" * 700 + "b" * 50 + "a" * 90, "q " * 900 + items[-1][2100:2300] + " q" * 900, "ab" * 400]
    index = D.Index(list(enumerate(items)))
    want = sorted(index.find(*one_buffer(docs)))
    monkeypatch.setattr(D, "HITS", hits)
    assert sorted(index.find(*one_buffer(docs))) == want and {len(items) - k for k in range(1, 5)} <= {m[1] for m in want}


def test_segments_hold_every_window():
    rng = random.Random(9)
    for n in (1, 99, 100, 1023, 1024, 1025, 1948, 1949, 1950, 5000):
        b = np.frombuffer(bytes(rng.randrange(256) for _ in range(n)), np.uint8)
        got = {s.tobytes()[k:k + 100] for s in D.segments(b) for k in range(max(len(s) - 99, 1))}
        assert got == {b.tobytes()[k:k + 100] for k in range(max(n - 99, 1))} and all(len(s) <= D.SEGMENT for s in D.segments(b))
