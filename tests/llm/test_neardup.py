"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselore.llm import neardup, shingles
from caselore.llm.common import utf8


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = name[i], name[j]
                name = [b if x == a else x for x in name]
    least = {}
    for (d, _), x in zip(rows, name):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted(((d, len(s), least.get(x)) for (d, _), s, x in zip(rows, sets, name)), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \n\té\x1c", max_size=30), min_size=1, max_size=8), st.sampled_from([4, 1 << 20]))
def test_sets(texts, chunk):
    before, shingles.CHUNK = shingles.CHUNK, chunk
    try:
        got = shingles.shingle_sets(*utf8(pa.array(texts)))
    finally:
        shingles.CHUNK = before
    assert [len(s) for s in got] == [len(plain_set(t)) for t in texts]
    for a, x in zip(texts, got):
        for b, y in zip(texts, got):
            assert shingles.shared(x, y) == len(plain_set(a) & plain_set(b))


def corpus(n_near=60, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, passage = [], [word() for _ in range(30)]
    for _ in range(80):
        rows.append([word() for _ in range(rng.randint(1, 60))] + (passage if rng.random() < 0.4 else []))
    for _ in range(12):  # pairs and chains around the threshold
        base = [word() for _ in range(rng.randint(20, 80))]
        for _ in range(4):
            rows.append(list(base))
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = word()
    base = [word() for _ in range(60)]
    for _ in range(n_near):  # a large group of near copies
        near = list(base)
        near[rng.randrange(60)] = word()
        rows.append(near)
    texts = [" ".join(r) for r in rows]
    texts += [texts[3]] * 5 + ["", None, "  ", "one", "One", "two words", texts[9].upper()]
    out = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[20]), (None, "nobody else"), (5, "second text of five")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small, pivots", [(96, 16), (8, 2)])
def test_against_all_pairs(spark, monkeypatch, small, pivots):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, v int, label string").repartition(3)
    got = neardup.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(rows)
    for r in got:
        assert r.kept == (r.doc_id == r.component_id if r.component_id is not None else True)


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "w " * 200_000 + "end"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (0, 2, True)}
    assert neardup.near_duplicates(df.where("doc_id > 5")).collect() == []


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    b = np.unique(np.r_[a[:3400], rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    exact = shingles.shared(a, b) / (len(a) + len(b) - shingles.shared(a, b))
    assert abs((shingles.sketch(a) == shingles.sketch(b)).mean() - exact) < 0.2


def families(seed=11):
    """Documents that share a template: mostly below the threshold, with linked pairs, parts of the template and a second template."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out, template, second = [], [word() for _ in range(120)], [word() for _ in range(14)]
    for i in range(90):
        own = [word() for _ in range(rng.choice([8, 20, 28, 28, 28, 36]))]
        own = second[:rng.randint(6, 14)] + own if i % 3 == 0 else own
        out.append(template + own)
        if i % 10 == 1:  # linked through own words, or just not
            other = list(own)
            for _ in range(rng.randint(1, 6)):
                other[rng.randrange(len(other))] = word()
            out.append(template + other)
        if i % 10 == 2:  # a template with holes
            part = list(template)
            for _ in range(rng.randint(1, 9)):
                part[rng.randrange(len(part))] = word()
            out.append(part)
        if i % 10 == 3:
            out.append(template[rng.randint(0, 30):])
    rng.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize("seed", [11, 12])
@pytest.mark.parametrize("plain", [0, 1 << 30])
def test_families_below_the_threshold(spark, monkeypatch, seed, plain):
    for name, value in dict(SMALL=8, PIVOTS=2, STRAY=8, PLAIN=plain).items():
        monkeypatch.setattr(neardup, name, value)
    rows = families(seed)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = plain_components(rows)
    assert 1 < len({x for _, _, x in want}) < len(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 40), min_size=1), st.integers(0, 9)), min_size=2, max_size=12), st.sampled_from([0, 1 << 21]))
def test_parts_of_a_cluster(members, most):
    """The comparison by a matrix and the one by pairs find the same parts."""
    before, neardup.TOKENS = neardup.TOKENS, most
    try:
        got = neardup.joined_names([np.array(sorted(s), np.uint64) for s, _ in members], np.array([x for _, x in members]))
    finally:
        neardup.TOKENS = before
    name = [x for _, x in members]
    for i, (a, _) in enumerate(members):
        for j, (b, _) in enumerate(members[:i]):
            if 100 * len(a & b) >= 75 * len(a | b):
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    assert [[x == y for y in got] for x in got] == [[x == y for y in name] for x in name]


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_filter_keeps_what_is_wanted(spark, monkeypatch, words):
    monkeypatch.setattr(neardup, "FILTER_WORDS", words)
    rows = spark.createDataFrame([(i if i else None, i * 7) for i in range(2000)], "id long, h long")
    wanted = rows.where("h % 5 = 0").toDF("w", "x")
    got = {r.h for r in neardup.may_be_in(rows, wanted, ["id", "h"], ["w", "x"]).collect()}
    assert got >= {i * 7 for i in range(0, 2000, 5)}
    assert words == 1 or len(got) == 400
