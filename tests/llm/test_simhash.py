"""SimHash fingerprints and components against plain code."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from caselore.llm import golay, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(UPPER))
    parts = [words[k:k + 3] for k in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    """Row -> smallest id of the rows it can be reached from."""
    name = list(range(len(prints)))

    def root(k):
        while name[k] != k:
            name[k] = name[name[k]]
            k = name[k]
        return k

    u = np.array(prints, np.uint64)
    for k in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(u[:k] ^ u[k]) <= 2):
            name[root(k)] = root(int(j))
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(prints))]


def test_code_is_perfect():
    words = np.arange(1 << 23)
    _, patterns, count = golay.tables()
    assert set(count.tolist()) == {1, 6} and (count == 6).sum() == 1771
    keys, n = golay.fuzzy_keys(words[::97])
    assert keys.min() >= 0 and keys.max() < 4096 and set(n.tolist()) == {1, 6}
    assert len(set(golay.fuzzy_keys(words[:2048])[0][:, 0].tolist())) <= 2048 and patterns.shape == (2048, 6)


@given(st.integers(0, 2**23 - 1), st.sets(st.integers(0, 22), max_size=2))
@settings(max_examples=300, deadline=None)
def test_words_within_two_bits_share_a_key(word, flips):
    other = word ^ sum(1 << b for b in flips)
    keys, n = golay.fuzzy_keys(np.array([word, other]))
    assert set(keys[0, :n[0]]) & set(keys[1, :n[1]])


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
@settings(max_examples=300, deadline=None)
def test_fingerprints_within_two_bits_share_a_bucket(fp, flips):
    row, key = simhash.bucket_keys(np.array([fp, fp ^ sum(1 << b for b in flips)], np.uint64).view(np.int64))
    assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


ODD = ["", None, " \t\n", "one", "One two", "a b c", "A  b\tc d", "ä Ö ß 日本 x", "word " * 5000, "x" * 200_000, "\x0b\x0c", "a b c", "0"]


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choices(["alpha", "Beta", "c", "é", "\t"], k=rng.randrange(0, 90))) for _ in range(60)]
    import pyarrow as pa

    from caselore.llm.common import utf8
    got = simhash.fingerprints(*utf8(pa.array(texts)))
    assert got.tolist() == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints(*utf8(pa.array([], pa.string()))).tolist() == []


@pytest.mark.parametrize("bucket", [128, 4])
def test_components_against_brute_force(spark, monkeypatch, bucket):
    """With small buckets most of the work is done by midpoints; the result is the same."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(40, 400))
        for _ in range(rng.randrange(1, 30)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rows = [(None if k in (3, 9) else 1000 - k // 2 * 2, t, "x", k) for k, t in enumerate(texts)]  # ids repeat
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int").repartition(5)
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    want = sorted(zip(map(str, [r[0] for r in rows]), [f"{p:016x}" for p in prints], plain_components(prints, [r[0] for r in rows]),
                      strict=True), key=str)
    got = sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want and len({x[2] for x in want}) < len(set(prints))


def test_a_family_in_one_ball(spark):
    """Thousands of fingerprints around a few centres: crowded buckets, chains of links, one result."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for c in centre for _ in range(900)]
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(df).collect()]
    u = fps.view(np.int64).tolist()
    assert all((a ^ b).bit_count() <= 2 or a in u for a, b in edges)
    name = {x: x for x in u}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in edges:
        name[root(a)] = root(b)
    want = plain_components(fps.tolist(), list(range(len(fps))))
    mine = {}
    for k, x in enumerate(u):
        mine.setdefault(root(x), []).append(k)
    assert sorted(min(m) for m in mine.values() for _ in m) == sorted(want)
    assert len(edges) < 65 * len(u)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
