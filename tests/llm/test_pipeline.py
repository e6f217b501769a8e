"""The pipeline against stage decisions made by hand."""

import os

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from caselore.llm import decontaminate, neardup, quality, queries, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="the tables are not here")


def test_stages_against_their_decisions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model, chain = queries.quality_model(spark, DATA), queries.toxicity_chain(spark, DATA)
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.5").collect()}
    civil = {r.doc_id for r in toxicity.score(docs, chain).where("p_toxic < 0.5").collect()} & good
    left = docs.where(docs.doc_id.isin(list(civil)))
    first = {r.doc_id for r in neardup.near_duplicates(left).where("kept").collect()}
    leaked = {r.doc_id for r in decontaminate.matches(left, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    want = first - leaked
    pieces = corpus_pipeline.run(spark, DATA).collect()
    assert {p.doc_id for p in pieces} == want and len(want) > 100 and leaked and len(first) < len(civil) < 200
    last = max(p.sequence_id for p in pieces)
    filled = {}
    for p in pieces:
        filled[p.sequence_id] = filled.get(p.sequence_id, 0) + p.length
    assert all(n == 1024 for s, n in filled.items() if s != last)


def test_filters_keep_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    text = docs.first().text
    odd = spark.createDataFrame([(None, text, "en", "s", 1), (None, None, None, None, None), (3, "a second text under three", "en", "s", 1),
                                 (3, "a second text under three", "en", "s", 1)], docs.schema)
    rows = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, DATA)
        assert kept.columns == docs.columns
        assert kept.where("doc_id is null and text is null").count() <= 1
        assert kept.count() > 30
        assert stage(spark, rows.where("doc_id < -5"), DATA).count() == 0
    deduped = corpus_pipeline.keep_one_of_each(spark, rows, DATA)
    assert deduped.where("text = 'a second text under three'").count() == 2
    assert deduped.where("doc_id is null").count() == 1


def test_columns_of_any_name(spark):
    """Every stage keeps further columns, also those with the names it would use itself."""
    extra = ["quality_score", "p_toxic", "p_low_quality", "leaked", "gone_id", "gone_hash", "text_to_score", "text_to_search",
             "text_hash", "kept", "score", "label_id", "id", "v", "w", "fp", "n", "a.b"]
    plain = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, docs, DATA), stage(spark, plain, DATA)
        assert got.columns == docs.columns, name
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect()), name
        assert [tuple(r)[5:] for r in got.limit(1).collect()] == [tuple(range(len(extra)))]
    name, pack = corpus_pipeline.STAGES[-1]
    assert pack(spark, docs, DATA).count() == pack(spark, plain, DATA).count()
