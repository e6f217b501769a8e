"""Registered queries whose index is too large to be shipped: the rows of the plain search, through blocks."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry
from caselore.operators import retrieve as R
from caselore.operators import vectors as X
from caselore.plans import answer_queries as Q
from caselore.sources import adapters as A

NAMES = """candidate_prompt claims degraded_answer generation_breakdowns generation_report policy_notes route_by_tier score_percentiles
search_hits selection_distributions support_prior_rank template_fallback threshold_curve abstention_auroc alpha_sweep answer_batch
answer_samples apply_selection best_attempt draft_prompt gold_position headline_comparison""".split()  # F2 to F23


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same small tables under two paths, as tables that queries share are kept by path."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(64, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[33] = vectors[17]  # an exact tie of two patterns
    days = [f"1999-{m:02d}-{d:02d} 00:00:00" for m in range(1, 10) for d in (3, 17)]
    words = ["The parcel came late.", "Nobody answered for 3 days.", "It will arrive tomorrow.", "A new one was sent.", ""]
    tables = {
        "embeddings": ([(i, [float(x) for x in v], i % 10) for i, v in enumerate(vectors)],
                       "vec_id long, embedding array<float>, label int"),
        "orders": ([(o, days[o % 18]) for o in range(300)], "o_orderkey long, o_orderdate string"),
        "lineitem": ([(o, n, int(p), 0, f"1999-11-{n + o % 20 + 1:02d} 00:00:00", float(1 + p * n % 50), "ARN"[o % 3], "OF"[n % 2])
                      for o in range(300) for n, p in enumerate(rng.integers(0, 200, 6), 1)],
                     "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_quantity double, "
                     "l_returnflag string, l_linestatus string"),
        "documents": ([(i, None if i == 5 else "\n".join(words[(i + j) % 5] for j in range(1 + i % 6))) for i in range(130)],
                      "doc_id long, text string"),
        "conversations": ([(i, t, "assistant" if t % 2 else "user", "x" * (i + t)) for i in range(130) for t in range(6)],
                          "conv_id long, turn long, role string, text string")}
    paths = [str(tmp_path_factory.mktemp(way)) for way in ("shipped", "blocks")]
    for name, (rows, schema) in tables.items():
        for path in paths:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return paths


class Blocks(X.PreparedIndex):
    """An index that counts as too large to be shipped, in several shards."""

    def __init__(self, index, payload=()):
        super().__init__(index, payload, broadcast_limit=-1, shard_rows=25)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_same_rows_by_blocks(spark, folders, monkeypatch, name):
    run = entry.queries()[name]
    shipped = sorted(map(str, run(spark, folders[0]).collect()))
    monkeypatch.setattr(R, "PreparedIndex", Blocks)
    assert shipped and sorted(map(str, run(spark, folders[1]).collect())) == shipped


def test_texts_are_read_only_where_they_are_shown(spark, folders):
    """Neither the cases nor the answers carry the texts of complaints; a draft's text moves once, not once per attempt."""
    assert "complaint" not in Q.cases(spark, folders[0]).columns and "complaint" not in Q.kept_answers(spark, folders[0]).columns
    drafts = A.drafts(spark, folders[0])._jdf.queryExecution().executedPlan().toString()
    assert drafts.count("Exchange") == 1 and drafts.index("Generate") < drafts.index("Exchange")
    with_vectors, texts = A.complaints(spark, folders[0]), A.complaint_texts(spark, folders[0])
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(map(str, texts.collect())) == sorted(map(str, with_vectors.select(*texts.columns).collect()))


def test_the_search_behind_the_metrics_runs_once(spark, folders, monkeypatch):
    monkeypatch.setattr(R, "PreparedIndex", Blocks)
    plan = entry.queries()["alpha_sweep"](spark, folders[1])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "CartesianProduct" not in plan and "Cogroup" not in plan
