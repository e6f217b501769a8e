"""The training-data pipeline over documents. Each stage reads what the one before has kept and written.

1. quality: rows that the quality classifier scores below 0.5 go.
2. toxicity: rows that the classifier chain holds to be toxic go.
3. near duplicates: of each component one document stays, the one with the smallest id.
4. decontamination: rows that hold a stretch of a benchmark item go.
5. packing: the texts left become sequences of 1,024 tokens; the result are their pieces.

Rows without id or text take part like any other; repeated rows share their fate; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselore.llm import decontaminate, neardup, packing, quality, queries, toxicity
from caselore.llm.common import free_name, table, written
from caselore.llm.token_counts import vocabulary_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name("quality_score", docs)
    scored = quality.score(docs, queries.quality_model(spark, sf_dir), name=name)
    return scored.where(F.col(name) >= queries.QUALITY_FROM).drop(name)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = queries.toxicity_chain(spark, sf_dir)
    prefix = "p_"
    while any(free_name(prefix + n, docs) != prefix + n for n in chain.names):
        prefix += "_"
    scored = toxicity.score(docs, chain, prefix=prefix)
    return scored.where(F.col(prefix + "toxic") < queries.TOXIC_FROM).drop(*[prefix + n for n in chain.names])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Dropped documents are named by id and text, so rows without id and ids with several texts are told apart."""
    gone_id, gone_hash = free_name("gone_id", docs), free_name("gone_hash", docs)
    found = neardup.near_duplicates(docs).where(~F.col("kept")).select(
        F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (text_hash == F.col(gone_hash)), "left_anti")


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name("leaked", docs)
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), name=name).where(~F.col(name)).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path(), keep_ids=False).drop("piece")


STAGES = [("quality", keep_good), ("toxicity", keep_civil), ("near_duplicates", keep_one_of_each),
          ("decontamination", keep_unleaked), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
