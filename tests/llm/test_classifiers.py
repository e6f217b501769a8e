"""Quality and toxicity: known solutions on small data, held-out accuracy on the given labels, odd rows."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselore.llm import linear, ngrams, quality, queries, toxicity

DATA = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.exists(DATA), reason="the tables are not here")


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = np.where(x @ [1.0, -2, 0.5] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = linear.dual_descent([np.arange(3)] * 60, x.__getitem__, y, 3, epochs=500)

    def loss(w):
        return w @ w / 2 + np.maximum(0, 1 - y * (x @ w[:3] + w[3])).sum()

    assert all(loss(w) <= loss(w + 0.02 * rng.normal(size=4)) + 1e-3 for _ in range(300))


def test_logistic_curve():
    rng = np.random.default_rng(1)
    m = rng.normal(size=4000)
    a, b = linear.logistic_curve(m, (rng.random(4000) < 1 / (1 + np.exp(-(2 * m + 0.5)))).astype(float))
    assert abs(a - 2) < 0.25 and abs(b - 0.5) < 0.2


def test_ngrams_are_distinct_and_whole():
    long = "ab " * 50_000 + "END!!"
    got = list(ngrams.quality_ngrams(pa.array(["", None, "a", "abc abc", long])))
    assert [len(x) for x in got[:2]] == [0, 0]
    assert all(len(set(x.tolist())) == len(x) and x.min() >= 0 and x.max() < ngrams.QUALITY_SIZE for x in got[2:])
    assert ord("D") * 256 + ord("!") in set(got[4].tolist())


def test_toxic_features_by_text():
    texts = ["Loser, go", None, "", "lose lose", "go. LOSER"]
    found, owner = toxicity.features(pa.array(texts))
    by = {i: set(found[:, owner == i].ravel().tolist()) - {0} for i in range(5)}
    assert not by[1] and not by[2] and by[0] & by[4] and by[0] & by[3]
    for i, t in enumerate(texts):
        alone, _ = toxicity.features(pa.array([t]))
        assert set(alone.ravel().tolist()) - {0} == by[i]


def plain_words(n, seed=2):
    rng = random.Random(seed)
    return [[rng.choice(["ka", "lo", "mi", "ne", "ru"]) + rng.choice(["ta", "so", "vi"]) for _ in range(30)] for _ in range(n)]


def test_chain_learns_from_earlier_categories(spark):
    rows, marks = [], []
    rng = random.Random(4)
    for i, words in enumerate(plain_words(900)):
        insult, threat = rng.random() < 0.4, rng.random() < 0.3
        words += ["zogword"] * insult + ["hexword"] * threat
        rng.shuffle(words)
        rows.append((i, " ".join(words), 3.5))
        marks.append((i, int(insult), int(threat), int(insult or threat)))
    docs = spark.createDataFrame([*rows, (None, None, 1.0), (7, rows[7][1], 2.0)], "doc_id long, text string, threat double")
    labels = spark.createDataFrame([*marks, (None, 1, 1, 1), (5000, 1, 1, 1), (3, None, None, None)], "doc_id long, insult int, threat int, severe int")
    labels = labels.where("doc_id is null or doc_id % 3 <> 1")
    chain = toxicity.fit(docs, labels, {c: f"{c} = 1" for c in ("insult", "threat", "severe")})
    assert chain.links[2].earlier.shape == (2,) and (chain.links[2].earlier > 0.2).all()
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    right = sum((got[i].p_insult >= 0.5, got[i].p_threat >= 0.5, got[i].p_severe >= 0.5) == (a == 1, b == 1, c == 1)
                for i, a, b, c in marks if i % 3 == 1)
    assert right >= 295 and 0 <= got[None].p_severe <= 1 and got[7].threat in (3.5, 2.0)
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("p_insult", F.lit(1)), chain)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()] == [0.5, 0.5]
    chain = toxicity.fit(docs, labels, queries.CATEGORIES)
    assert [r.p_toxic for r in toxicity.score(docs, chain).collect()] == [0.0, 0.0]
    assert quality.score(docs.where("doc_id > 5"), None).collect() == []


@given
def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = queries.op8(spark, DATA).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == 1000 and len(held) > 100
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


@given
def test_toxic_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    chain = toxicity.fit(docs, labels.where("doc_id % 4 <> 1"), queries.CATEGORIES)
    toxic = {r.doc_id: r.toxic for r in labels.where("doc_id % 4 = 1").collect()}
    got = [r for r in toxicity.score(docs, chain).collect() if r.doc_id in toxic]
    assert sum((r.p_toxic >= 0.5) == (toxic[r.doc_id] == 1) for r in got) >= 0.93 * len(got)


def test_fold_features_come_from_other_folds(spark):
    rows = [(i, f"plain words here {i % 7}", [i % 2]) for i in range(200)]
    own = [(1000 + i, [1], 0) for i in range(40)]  # a hash that tells the category, in rows of fold 0 alone
    sample = spark.createDataFrame([([i % 7], m, i % 5) for i, _, m in rows] + [([99], m, f) for _, m, f in own],
                                   "found array<long>, marks array<int>, fold int")
    kept = toxicity.telling(sample, ["c"])
    assert len(kept) == 1 + toxicity.FOLDS
    assert 99 in kept[0][0] and 99 not in kept[1][0] and all(99 in k[0] for k in kept[2:])
