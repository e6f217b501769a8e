"""M-tree search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselore.llm import mtree


def brute(rows, k, every):
    fine = [(i, np.array([math.floor(256 * x) for x in v], object)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine = [(i, v) for i, v in fine if (v * v).sum() < 2**62]  # larger ones take no part
    out = set()
    for q, v in fine:
        if q % every == 0:
            found = sorted((-int(v @ w), i) for i, w in fine if i != q and len(w) == len(v))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("leaf, tree_rows, large", [(4, 64, None), (128, 4096, None), (4, 64, 4e5), (128, 4096, 3e6)])
def test_against_brute_force(spark, monkeypatch, leaf, tree_rows, large):
    monkeypatch.setattr(mtree, "TREE_BLOCK", 2)
    monkeypatch.setattr(mtree, "LEAF", leaf)
    monkeypatch.setattr(mtree, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 560)]  # many equal ones
    rows += [(600 + i, [float(i), 2.0]) for i in range(4)]  # another length
    rows += [(700, None), (710, [1.0, None]), (720, [math.nan] * 8), (730, [math.inf] * 8), (None, [1.0] * 8)]
    if large:  # norms beyond what a double holds, and one too large to take part
        rows += [(800 + i, [float(x) for x in large * rng.normal(size=8)]) for i in range(60)] + [(790, [3e9] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id != 790]
    got = mtree.top_k(df, F.col("vec_id") % 10 == 0, k=5).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows, 5, 10)


def test_bounds_save_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 6)) * 2000
    v = np.floor(np.concatenate([c + rng.normal(size=(100, 6)) * 20 for c in centres]))
    sphere = float((v * v).sum(1).max())
    tree = mtree.Tree(mtree.build(0, np.arange(len(v)), v, sphere), 6, sphere)
    seen = []
    tree.pages = type("Counting", (dict,), {"__getitem__": lambda s, k: seen.append(k) or dict.__getitem__(s, k)})(tree.pages)
    for q in v[:50]:
        got = tree.search(-1, q, 5, -math.inf)
        assert [-s for s, _ in got] == sorted((v @ q), reverse=True)[:5]
    assert len(seen) < 0.5 * 50 * len(tree.pages)


def test_few_rows_and_repeats(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in mtree.top_k(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 256 * 512), (0, 2, 1, 256 * 512)]
    assert mtree.top_k(df.where("vec_id > 5"), F.col("vec_id") == 0).collect() == []


def test_trees_are_ruled_out():
    """Of clustered vectors a query reaches few trees, and never loses one that holds a better vector."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 6)) * 3000
    groups = [np.floor(c + rng.normal(size=(80, 6)) * 30) for c in centres]
    sphere = max(float((g * g).sum(1).max()) for g in groups)
    roots = [next(p for p in mtree.build(t, np.arange(80), g, sphere).itertuples() if p.page == 0) for t, g in enumerate(groups)]
    routers = np.stack([mtree.SMALL.vector(p.router) for p in roots])
    radii = np.array([np.frombuffer(p.to_parent).max() for p in roots])
    queries = np.concatenate([g[:5] for g in groups])
    scores = [np.sort(g @ q)[::-1] for q, g in zip(queries, np.repeat(groups, 5, axis=0), strict=True)]
    fine = mtree.in_reach(queries, np.array([s[4] for s in scores]), routers, radii, sphere)
    for q, s, row in zip(queries, scores, fine, strict=True):
        assert all(row[t] for t, g in enumerate(groups) if (g @ q).max() >= s[4])
    assert fine.mean() < 0.5
    assert mtree.in_reach(queries[:1], np.array([-math.inf]), routers, radii, sphere).all()
