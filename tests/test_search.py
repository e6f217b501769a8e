from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselore.operators import evaluate as H
from caselore.operators import retrieve as R
from caselore.operators import vectors as X
from caselore.sources import adapters as A


def frame(spark, m, name="query_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<double>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(60, 8)), rng.normal(size=(90, 8))
    v[10] = v[3]  # an exact tie
    return frame(spark, q), frame(spark, v, "vec_id"), q, v


def neighbours(df):
    return {r.query_id: [(n.vec_id, n.score) for n in r.neighbours] for r in df.collect()}


def test_knn_is_exact(data):
    q, v, qm, vm = data
    got = neighbours(X.knn(q, v, 7))
    scores = np.round(qm @ vm.T, 9)
    for i, row in enumerate(scores):
        assert [n for n, _ in got[i]] == list(np.lexsort((np.arange(90), -row))[:7])


def test_blocked_search_equals_shipped(data):
    q, v, _, _ = data
    a = neighbours(X.knn(q, v, 7))
    b = neighbours(X.knn(q, v, 7, broadcast_limit=-1, shard_rows=20, block_rows=15))
    assert a == b
    assert {len(x) for x in neighbours(X.knn(q, v, 500)).values()} == {90}
    for limit in (1 << 20, -1):
        assert {len(x) for x in neighbours(X.knn(q, v.limit(0), 5, broadcast_limit=limit)).values()} == {0}
        assert X.knn(q.limit(0), v, 5, broadcast_limit=limit).collect() == []


def test_repeated_and_null_query_ids(spark, data):
    _, v, _, vm = data
    rows = [(1, [float(x) for x in vm[5]]), (1, [float(x) for x in vm[6]]), (None, [float(x) for x in vm[7]])]
    q = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    want = sorted((str(i), int(np.lexsort((np.arange(90), -np.round(vm @ np.array(e), 9)))[0])) for i, e in rows)
    for options in ({}, {"broadcast_limit": -1, "shard_rows": 20, "block_rows": 1}):
        got = sorted((str(r.query_id), r.neighbours[0].vec_id) for r in X.knn(q, v, 1, **options).collect())
        assert got == want


def test_blocked_search_with_a_payload_that_is_never_null(spark, data):
    q, v, _, _ = data
    v = v.withColumn("name", F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    assert not v.schema["name"].nullable
    shipped, blocked = (X.knn(q, v, 3, ["name"], broadcast_limit=limit, shard_rows=20) for limit in (1 << 20, -1))
    assert sorted(map(str, shipped.collect())) == sorted(map(str, blocked.collect()))


def test_blocked_search_moves_each_side_once(spark, data):
    """No row is copied for a pair of blocks, and no partial result is shuffled: the disk holds each side once."""
    q, v, _, _ = data
    plans = []
    for rows in (90, 5):  # one shard of the index or 18
        near = X.knn(q, v, 7, broadcast_limit=-1, shard_rows=rows, block_rows=15)
        plans.append(near._jdf.queryExecution().executedPlan().toString())
        assert plans[-1].count("Exchange") == 1 and "Generate" not in plans[-1] and "Sort" not in plans[-1]
    assert near.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("piece", [1, 7, 64, 400])
def test_nearest_rows_of_an_index_in_pieces(piece):
    """Any order of the pieces, ties across them, rows that all tie, queries and rows out of the range of single precision."""
    rng = np.random.default_rng(4)
    q, v = rng.normal(size=(50, 16)), rng.normal(size=(400, 16))
    v[100:180] = v[3]
    v[200:203], q[0], q[1], q[2] = 0.0, 0.0, q[1] * 1e40, -v[3]
    v[210] *= 1e25
    ids = rng.permutation(400)
    near = X._Nearest(q, 30)
    for start in range(0, 400, piece):
        near.add(v[start:start + piece], ids[start:start + piece], start)
    near.merge()
    query, score, vec, place = near.best
    scores = np.round(q @ v.T, 9) + 0.0
    for i in (x for x in range(50) if x != 1):  # its scores are equal up to their last bits only
        want = np.lexsort((ids, -scores[i]))[:30]
        assert list(vec[query == i]) == list(ids[want]) and list(place[query == i]) == list(want)
    assert np.allclose(score[query == 1], -np.sort(-scores[1])[:30], rtol=1e-12)


def test_nearest_rows_hold_a_bounded_part_of_ties():
    q, v = np.ones((2_000, 4)), np.ones((8_000, 4))
    near = X._Nearest(q, 5)
    tracemalloc.start()
    for start in range(0, 8_000, 2_000):
        near.add(v[start:start + 2_000], np.arange(8_000 - start, 6_000 - start, -1), start)
    near.merge()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near.best[2].reshape(2_000, 5).tolist() == [[1, 2, 3, 4, 5]] * 2_000 and peak < 100 << 20


def test_search_holds_a_bounded_block_of_scores():
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(2_000, 4)), rng.normal(size=(3_000, 4))
    tracemalloc.start()
    got = list(X._best(q, v, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2_000 and peak < 64 << 20


def test_size_counts_numbers_and_payload(spark):
    rows = [(i, [1.0] * 50, "p" * 100) for i in range(20)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, name string")
    assert X.PreparedIndex(v, broadcast_limit=20 * 50 * 16).shared is None
    assert X.PreparedIndex(v, ["name"], broadcast_limit=20 * (50 * 16 + 16)).shared is None
    assert X.PreparedIndex(v, ["name"], broadcast_limit=20 * (50 * 16 + 16 + 100)).shared is not None


def test_upsert_remove_and_shape(spark):
    v = frame(spark, [[1, 0], [0, 1]], "vec_id")
    new = frame(spark, [[0.5, 0.5]], "vec_id").unionByName(frame(spark, [[9, 9]], "vec_id").withColumn("vec_id", F.lit(7).cast("long")))
    out = {r.vec_id: r.embedding for r in X.upsert_vectors(v, new, 2).collect()}
    assert out == {0: [0.5, 0.5], 1: [0.0, 1.0], 7: [9.0, 9.0]}
    assert X.remove_vectors(v, new).count() == 1
    with pytest.raises(Exception, match="expected vectors of length 3"):
        X.upsert_vectors(v, new, 3).collect()


def test_vector_ids_round_trip(spark):
    df = spark.createDataFrame([("ffffffffff", 15), ("0000000001", 0), ("00a1b2c3d4", 7)], "p string, s int")
    ids = df.withColumn("v", X.pack_vector_id(F.col("p"), F.col("s")))
    for r in ids.select("p", "s", "v", X.unpack_pattern(F.col("v")).alias("q"), X.unpack_slot(F.col("v")).alias("t")).collect():
        assert (r.q, r.t) == (r.p, r.s) and r.v == int(r.p, 16) << 4 | r.s and r.v > 0


def pool_fixture(spark):
    rows = [("a", 1, 0.9, 10), ("a", 2, 0.95, 10), ("b", 3, 0.94, 1000), ("gone", 4, 0.99, None), ("c", 5, 0.5, 3)]
    near = spark.createDataFrame([(1, [(v, p, n, s) for p, v, s, n in sorted(rows, key=lambda r: -r[2])])],
                                 "query_id long, neighbours array<struct<vec_id:long,pattern_id:string,total_cases:long,score:double>>")
    return near


def ranks(near, **kw):
    return [(h.pattern_id, h.score) for h in near.select(R.rank_patterns(F.col("neighbours"), 5, **kw)).first()[0]]


def test_pool_rank_and_floor(spark):
    near = pool_fixture(spark)
    assert ranks(near) == [("a", 0.95), ("b", 0.94), ("c", 0.5)]
    assert ranks(near, alpha=0.04) == [("b", 0.94), ("a", 0.95), ("c", 0.5)]
    assert ranks(near, min_cases=5) == [("a", 0.95), ("b", 0.94)]


def test_labels_find_themselves(spark, history):
    q = history.vectors.where("slot = 0").select(F.col("pattern_id").alias("query_id"), "embedding")
    r = R.rank_queries(q, history.vectors, history.patterns, 1)
    assert all(x.query_id == x.pattern_id and abs(x.score - 1) < 1e-9 for x in r.collect()) and r.count() == 3


def test_metrics_on_a_hand_case(spark):
    scored = spark.createDataFrame([
        (0.0, 0, "t", "t", 10, 0.0, 1.0), (0.0, 4, "t", "u", 30, 0.5, 0.5), (0.0, 10**6, "t", "t", 60, 1.0, 0.0)],
        "alpha double, pos long, gold_type string, top1_type string, cases long, tv double, coverage double")
    m = H.retrieval_metrics(scored).first()
    assert (m.recall_at_1, m.recall_at_5, m.volume_weighted_recall_at_1) == (1 / 3, 2 / 3, 0.1)
    assert abs(m.mrr_at_10 - (1 + 0.2) / 3) < 1e-12 and abs(m.category_at_1 - 2 / 3) < 1e-12


def test_auroc_against_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0.6, 0.1, 200).round(2), rng.normal(0.5, 0.1, 80).round(2)
    df = spark.createDataFrame([(True, float(x)) for x in a] + [(False, float(x)) for x in b], "in_domain boolean, score double")
    want = (a[:, None] > b[None, :]).mean() + 0.5 * (a[:, None] == b[None, :]).mean()
    assert abs(H.abstention_auroc(df).first().auroc - want) < 1e-12
    curve = {r.threshold: r for r in H.threshold_curve(df).collect()}
    assert len(curve) == 18 and abs(curve[0.6].in_domain_kept - (a >= 0.5 + 0.02 * 5).mean()) < 1e-12


def test_vector_tickets_ship_the_vector_labels(spark, tmp_path):
    """Two numbers a vector are shipped even where the embeddings' file is too big to be; tickets move once, for the orders."""
    spark.createDataFrame([(i, 9 if i == 4 else i, [1.0]) for i in range(5)], "vec_id long, label int, embedding array<float>"
                          ).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(o, "1999-01-01 00:00:00") for o in range(3)], "o_orderkey long, o_orderdate string").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(o, 1, p, 0, "1999-01-03 00:00:00", 50.0, "R", "F") for o, p in ((0, 3), (1, 9), (2, 10), (7, 1))],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, "
                          "l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = A.vector_tickets(spark, str(tmp_path))
        plan = t._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.unique_key, r.complaint_type, r.descriptor) for r in t.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == [("0-1-3-0", "CLASS 3", "Block 0"), ("1-1-9-0", "CLASS 4", "Block 0"), ("2-1-10-0", "CLASS 0", "Block 0")]
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
