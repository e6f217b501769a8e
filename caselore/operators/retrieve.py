"""From neighbours to pattern hits: pool, rank, floor, attach the recorded outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numbers import let, round_half_even
from ..functions.ranking import top_per_key
from .vectors import SCORE_PLACES, PreparedIndex, knn


def max_pool(neighbours: Column) -> Column:
    """The best vector of each pattern; vectors whose pattern is gone are dropped. No shuffle: works inside the row."""
    live = F.filter(neighbours, lambda n: n["total_cases"].isNotNull() & (n["score"] > -1.0))
    # live is sorted by score: the first place of a pattern is its best vector.
    return let(live, lambda found: let(
        F.transform(found, lambda n: n["pattern_id"]),
        lambda ids: F.filter(found, lambda n, i: F.array_position(ids, n["pattern_id"]) == i + 1)))


def rank_pooled(pooled: Column, k: int, alpha: Column | float = 0.0, min_cases: int = 0) -> Column:
    """Top k pooled patterns by cosine + alpha * log10(1 + cases); the score shown stays the raw cosine."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    kept = F.filter(pooled, lambda n: n["total_cases"] >= min_cases)
    keyed = F.transform(kept, lambda n: F.struct(
        (-F.round(n["score"] + alpha * F.log10(n["total_cases"] + 1), SCORE_PLACES)).alias("sort_key"),
        n["pattern_id"].alias("pattern_id"), n["score"].alias("score"), n["total_cases"].alias("total_cases")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda n, i: F.struct(
        (i + 1).alias("rank"), n["pattern_id"].alias("pattern_id"), n["score"].alias("score")))


def rank_patterns(neighbours: Column, k: int, alpha: Column | float = 0.0, min_cases: int = 0) -> Column:
    return rank_pooled(max_pool(neighbours), k, alpha, min_cases)


def live_index(vectors: DataFrame, patterns: DataFrame) -> DataFrame:
    """Vectors with the case count of their pattern (null where the pattern is gone)."""
    return vectors.select("vec_id", "pattern_id", "embedding").join(
        patterns.select("pattern_id", "total_cases"), "pattern_id", "left")


def prepare(vectors: DataFrame, patterns: DataFrame, **options) -> PreparedIndex:
    """The searchable form of one version of the index; release it when the version is replaced."""
    return PreparedIndex(live_index(vectors, patterns), ["pattern_id", "total_cases"], **options)


def neighbours(queries: DataFrame, vectors: DataFrame | PreparedIndex, patterns: DataFrame | None, k: int, **options) -> DataFrame:
    """The k * 16 nearest vectors: a pattern owns at most 16, so k patterns are always among them."""
    index = vectors if isinstance(vectors, PreparedIndex) else prepare(vectors, patterns, **options)
    return knn(queries, index, k * V.SLOTS)


def rank_queries(queries: DataFrame, vectors: DataFrame | PreparedIndex, patterns: DataFrame | None = None, k: int = 5,
                 alpha: float = 0.0, min_cases: int = 0, **options) -> DataFrame:
    """One row per (query, rank): pattern_id and raw cosine, plus the columns of the query."""
    near = neighbours(queries, vectors, patterns, k, **options)
    hits = near.withColumn("hit", F.explode(rank_patterns(F.col("neighbours"), k, alpha, min_cases)))
    return hits.select(*[c for c in near.columns if c != "neighbours"], "hit.*")


def pattern_cards(patterns: DataFrame, counts: DataFrame, resolutions: DataFrame, top: int) -> DataFrame:
    """Pattern rows with their first ``top`` outcomes and the recorded text of each."""
    first = top_per_key(counts.select("pattern_id", "resolution_id", "count"), ["pattern_id"],
                        [F.desc("count"), F.col("resolution_id")], top)
    first = (first.join(patterns.select("pattern_id", "total_cases"), "pattern_id")
             .join(resolutions.select("resolution_id", F.col("resolution_description").alias("text")), "resolution_id")
             .withColumn("share", round_half_even(F.col("count") / F.col("total_cases"), 4)))
    item = F.struct("rank", "resolution_id", "share", "count", "text")
    lists = first.groupBy("pattern_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return patterns.join(lists, "pattern_id", "left").withColumn("resolutions", F.transform(
        "items", lambda x: F.struct(x["resolution_id"].alias("resolution_id"), x["share"].alias("share"),
                                    x["count"].alias("count"), x["text"].alias("text")))).drop("items")


def search_hits(ranked: DataFrame, cards: DataFrame) -> DataFrame:
    return ranked.join(cards, "pattern_id")
