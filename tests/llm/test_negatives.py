"""Packed products against plain ones, and hard negatives against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselore.llm import negatives
from caselore.llm.kronecker import Packed


@given(st.integers(1, 40), st.integers(1, 12), st.integers(0, 40), st.integers(0, 2**32))
@settings(max_examples=80, deadline=None)
def test_packed_products(n, dim, bits, seed):
    rng = np.random.default_rng(seed)
    most = 1 << bits
    rows, anchor = rng.integers(-most, most + 1, (n, dim)), rng.integers(-most, most + 1, dim)
    packed = Packed(rows, int(anchor.min()), int(anchor.max()))
    want = [sum(int(a) * int(b) for a, b in zip(r, anchor, strict=True)) for r in rows]
    assert [int(s) for s in packed.scores(anchor)] == want


def test_fields_of_a_word():
    rng = np.random.default_rng(1)
    packed = Packed(rng.integers(-256, 257, (101, 64)), -256, 256)
    assert packed.words and packed.fields == 2 and packed.packed.shape == (64, 51)
    assert Packed(rng.integers(0, 4, (100, 64)), 0, 3).fields == 6
    assert not Packed(np.full((3, 2), 2**27), 0, 2**27).words
    assert Packed(np.zeros((0, 3), np.int64), -1, 1).scores(np.ones(3, int)).tolist() == []


def brute(rows, every, seventh=True):
    fine = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in w) >= 2**56:
            continue
        fine.append((i, w, (label + 1) % 10 if seventh and i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, v, label in {(i, tuple(v), x) for i, v, x in fine if i % every == 0}:
        mine = sorted((-dot(v, w), i) for i, w, x in fine if i != a and x == label and len(w) == len(v))[:5]
        others = sorted((-dot(v, w), i) for i, w, x in fine if x != label and len(w) == len(v))
        for s, p in mine:
            s = -s
            inside = [(i, -n) for n, i in others if 50 * s <= -100 * n <= 95 * s][:3]
            out += [(a, p, k + 1, i, s, n) for k, (i, n) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 8192])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 8)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0.2, 0.4, 6)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(i, [0.5] * 6, 1) for i in range(300, 380)]  # equal vectors: ties
    rows += [(i, [float(i % 3), 1.0], i % 4) for i in range(400, 430)]  # another length
    rows += [(430, [3e9, 1.0], 1), (440, [2e5, 1.0], 1), (441, [1e5, 2.0], 2), (442, [1.2e5, 2.0], 1)]  # large components
    rows += [(500, None, 1), (510, [1.0, None], 1), (520, [math.nan] * 6, 2), (530, [math.inf] * 6, 2), (540, [1.0] * 6, None),
             (None, [1.0] * 6, 1), (550, [], 1), (20, [0.1] * 6, 2), (20, [0.1] * 6, 2), (560, [1e300] * 6, 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, id int, block int").repartition(4)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    got = negatives.hard_negatives(df, F.expr("vec_id % 10 = 0"), label)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == brute(rows, 10) and len(found) > 100


def test_empty_and_no_positives(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none = spark.createDataFrame([], schema)
    assert negatives.hard_negatives(none, F.lit(True)).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], schema)
    assert negatives.hard_negatives(alone, F.lit(True)).collect() == []
    only_null = spark.createDataFrame([(None, None, None)], schema)
    assert negatives.hard_negatives(only_null, F.lit(True)).collect() == []
