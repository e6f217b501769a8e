"""Best-fit-decreasing sharding."""

import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselore.llm import shards


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(rooms) if r >= s]
        if fits:
            _, b = min(fits)
            rooms[b] -= s
        else:
            b = len(rooms)
            rooms.append(max(capacity, s) - s)
        out.append(b)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=120), st.integers(1, 100))
def test_tree_gives_the_tightest_bin(sizes, capacity):
    sizes.sort(reverse=True)
    assert shards.best_fit(sizes, capacity) == plain_best_fit(sizes, capacity)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=200), st.integers(1, 30))
def test_levels(sizes, bins):
    sizes.sort(reverse=True)
    out = shards.level_fit(sizes, bins)
    sums = Counter()
    for s, b in zip(sizes, out):
        sums[b] += s
    assert max(out) < bins
    assert max(sums.values()) <= max(sizes[0], -(-sum(sizes) // bins) + sizes[0])


def docs(spark, n=3000):
    rows = [(i, "copy of one text " * 20 if i % 3 == 0 else f"text {i % 1500} " * (i % 40), "x") for i in range(n)]
    rows += [(None, None, "y"), (None, "", "y"), (7, "again", "z"), (7, "again", "z"), (n, "long " * 10000, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)


def facts(rows):
    per = defaultdict(list)
    for r in rows:
        per[r.shard].append(r)
    for parts in per.values():
        assert sorted(r.slot for r in parts) == list(range(len(parts)))
    return {s: sum(r.size for r in parts) for s, parts in per.items()}


def test_level_shards(spark):
    df = docs(spark)
    text = defaultdict(list)
    for r in df.collect():
        text[r.doc_id].append(r.text or "")
    rows = shards.shard(df, shards=6).collect()
    assert len(rows) == df.count()
    sums = facts(rows)
    assert set(sums) == set(range(6))
    home = defaultdict(set)
    for r in rows:
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 8, zlib.crc32(t.encode())) for t in text[r.doc_id]}
        home[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in home.values())
    largest = sum(r.size for r in rows if r.text_crc32 == zlib.crc32(("copy of one text " * 20).encode()))
    others = sorted(sums.values())[:-1]
    assert sorted(sums.values())[-1] == largest and max(others) - min(others) < 0.02 * max(others)


def test_capacity(spark):
    df = docs(spark)
    rows = shards.shard(df, capacity=120_000).collect()
    sums = facts(rows)
    over = [s for s in sums.values() if s > 120_000]
    assert len(over) == 1  # the hot group cannot be divided
    rest = sum(s for s in sums.values() if s <= 120_000)
    assert len(sums) - 1 <= -(-rest // 118_000) + 1


def test_empty_and_wrong_use(spark):
    assert shards.shard(docs(spark).where("doc_id < 0"), shards=3).collect() == []
    with pytest.raises(ValueError):
        shards.shard(docs(spark))
