"""Retrieval quality: recall, outcome distance and coverage, abstention, outside picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numbers import support_bucket
from ..functions.ranking import exact_percentiles, running_total
from ..session import materialise
from .changes import tv_distance
from .retrieve import max_pool, rank_pooled

ABSENT = 10**6


def eval_queries(examples: DataFrame) -> DataFrame:
    """One query per example complaint; its pattern is the right answer."""
    q = examples.select("pattern_id", F.posexplode("complaints").alias("pos", "complaint"))
    return q.select(F.concat_ws("-", "pattern_id", "pos").alias("query_id"), F.col("pattern_id").alias("gold_pattern"),
                    "complaint")


def gold_position(ranked: Column, gold: Column) -> Column:
    """0-based place of the right pattern among the ranked ones."""
    p = F.array_position(F.transform(ranked, lambda h: h["pattern_id"]), gold)
    return F.when(p > 0, p - 1).otherwise(F.lit(ABSENT)).cast("bigint")


def ranked_by_alpha(near: DataFrame, k: int = max(V.RECALL_KS), alphas: list[float] = V.ALPHAS) -> DataFrame:
    """Every support weight ranks the same pooled neighbours inside the row; search and pooling run once."""
    pooled = near.withColumn("neighbours", max_pool(F.col("neighbours")))
    each = pooled.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return each.withColumn("ranked", rank_pooled(F.col("neighbours"), k, F.col("alpha"))).drop("neighbours")


def scored_queries(ranked: DataFrame, patterns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per (query, alpha): position of the right pattern, its cases, category hit, outcome distance and coverage."""
    r = ranked.where(F.col("gold_pattern").isNotNull()).select(
        "query_id", "alpha", "gold_pattern", gold_position(F.col("ranked"), F.col("gold_pattern")).alias("pos"),
        F.transform(F.slice("ranked", 1, 3), lambda h: h["pattern_id"]).alias("top3"))
    # read three times: written, so that the search behind it runs once
    r = materialise(r.withColumn("top1", F.get("top3", F.lit(0))), "places")
    kinds = patterns.select("pattern_id", "complaint_type", "total_cases")
    gold = kinds.withColumnsRenamed({"pattern_id": "gold_pattern", "complaint_type": "gold_type", "total_cases": "cases"})
    first = kinds.select(F.col("pattern_id").alias("top1"), F.col("complaint_type").alias("top1_type"))
    tv = pair_tv(r.select("gold_pattern", "top1").distinct(), outcomes)
    cov = top3_coverage(r.select("gold_pattern", "top3").distinct(), outcomes)
    return (r.join(gold, "gold_pattern").join(first, "top1", "left")
            .join(tv, ["gold_pattern", "top1"], "left").join(cov, ["gold_pattern", "top3"], "left")
            .withColumn("coverage", F.coalesce("coverage", F.lit(0.0))))


def pair_tv(pairs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Distance of two patterns' outcome shares, once per distinct pair instead of once per query."""
    o = outcomes.select("pattern_id", "resolution_id", "share")
    keys = ["gold_pattern", "top1"]
    p = pairs.join(o, pairs.gold_pattern == o.pattern_id).select(*keys, "resolution_id", "share")
    q = pairs.join(o, pairs.top1 == o.pattern_id).select(*keys, "resolution_id", "share")
    return tv_distance(p, q, keys)


def top3_coverage(groups: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Share of the right pattern's outcomes that a notable outcome of a top-3 pattern covers."""
    keys = ["gold_pattern", "top3"]
    strong = outcomes.where(F.col("share") >= V.COVERAGE_MIN_SHARE).select("pattern_id", "resolution_id")
    seen = (groups.select(*keys, F.explode("top3").alias("pattern_id")).join(strong, "pattern_id")
            .select(*keys, "resolution_id").distinct())
    gold = outcomes.select(F.col("pattern_id").alias("gold_pattern"), "resolution_id", "share")
    return seen.join(gold, ["gold_pattern", "resolution_id"]).groupBy(*keys).agg(F.sum("share").alias("coverage"))


def retrieval_metrics(scored: DataFrame, keys: tuple = ("alpha",)) -> DataFrame:
    hit = {k: (F.col("pos") < k).cast("double") for k in V.RECALL_KS}
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[F.avg(h).alias(f"recall_at_{k}") for k, h in hit.items()],
        F.avg(F.when(F.col("pos") < 10, 1 / (F.col("pos") + 1)).otherwise(0.0)).alias("mrr_at_10"),
        F.avg((F.col("top1_type") == F.col("gold_type")).cast("double")).alias("category_at_1"),
        (F.sum(hit[1] * F.col("cases")) / F.sum("cases")).alias("volume_weighted_recall_at_1"),
        F.avg("tv").alias("resolution_tv_at_1"), F.avg("coverage").alias("resolution_coverage_at_3"))


def recall_by_support(scored: DataFrame) -> DataFrame:
    b = scored.withColumn("bucket", support_bucket(F.col("cases"), V.SUPPORT_BUCKETS))
    return b.groupBy("alpha", "bucket").agg(F.count(F.lit(1)).alias("n_queries"),
                                            F.avg((F.col("pos") < 1).cast("double")).alias("recall_at_1"))


def no_retrieval_tv(queries: DataFrame, patterns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Mean distance between the right pattern's outcomes and the volume-weighted prior of all patterns.

    Only outcomes a pattern has are joined; the prior mass of all others is what remains of its total.
    """
    cases = patterns.select("pattern_id", "total_cases")
    o = outcomes.select("pattern_id", "resolution_id", "share").join(cases, "pattern_id")
    total = cases.agg(F.sum("total_cases")).scalar()
    prior = o.groupBy("resolution_id").agg((F.sum(F.col("share") * F.col("total_cases")) / total).alias("prior"))
    mass = prior.agg(F.sum("prior").alias("m"))
    per = o.join(prior, "resolution_id").groupBy("pattern_id").agg(
        F.sum(F.abs(F.col("share") - F.col("prior"))).alias("near"), F.sum("prior").alias("own"))
    tv = per.select("pattern_id", (0.5 * (F.col("near") + mass.scalar() - F.col("own"))).alias("tv"))
    n = queries.where(F.col("gold_pattern").isNotNull()).groupBy(F.col("gold_pattern").alias("pattern_id")).agg(
        F.count(F.lit(1)).alias("n"))
    return n.join(tv, "pattern_id").agg(F.sum("n").alias("n_queries"),
                                        (F.sum(F.col("n") * F.col("tv")) / F.sum("n")).alias("no_retrieval_tv"))


# --- abstention ---


def top_scores(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("rank") == 1).select("query_id", "in_domain", "score")


def abstention_auroc(scores: DataFrame) -> DataFrame:
    """Chance that an in-domain query scores above an out-of-domain one, ties half. Equal scores are counted first."""
    per = scores.groupBy("score").agg(F.count_if("in_domain").alias("inside"), F.count_if(~F.col("in_domain")).alias("outside"))
    run = running_total(per, [], [F.col("score")], F.floor(F.col("score") * 10000), {"below": "outside"})
    won = F.sum(F.col("inside").cast("double") * (F.col("below") + 0.5 * F.col("outside")))
    return run.agg(F.sum("inside").alias("in_domain"), F.sum("outside").alias("out_of_domain"),
                   (won / (F.sum("inside").cast("double") * F.sum("outside"))).alias("auroc"))


def threshold_curve(scores: DataFrame) -> DataFrame:
    """Kept and rejected shares at every threshold, all in one pass."""
    s, inside = F.col("score"), F.col("in_domain")
    rows = F.array(*[F.struct(
        F.lit(t).alias("threshold"),
        F.avg(F.when(inside, (s >= 0.5 + 0.02 * i).cast("double"))).alias("in_domain_kept"),
        F.avg(F.when(~inside, (s < 0.5 + 0.02 * i).cast("double"))).alias("ood_rejected"))
        for i, t in enumerate(V.THRESHOLDS)])
    return scores.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def score_percentiles(scores: DataFrame) -> DataFrame:
    q = exact_percentiles(scores, ["in_domain"], "score", {"p5": 0.05, "median": 0.5}, width=0.001)
    return q.join(scores.groupBy("in_domain").agg(F.max("score").alias("max")), "in_domain")


# --- outside picks ---


def picked(ranked: DataFrame, selections: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per query: top hit, picked hit (if the number exists among the candidates), place of the right pattern."""
    kinds = patterns.select("pattern_id", "complaint_type")
    per = ranked.groupBy("query_id", "in_domain", "gold_pattern", "gold_type").agg(
        F.array_sort(F.collect_list(F.struct("rank", "pattern_id", "score"))).alias("hits"))
    j = per.join(selections, "query_id", "left")
    choice = F.coalesce("selected_candidate", F.lit(0))
    pick = F.when((choice >= 1) & (choice <= F.size("hits")), F.get("hits", choice - 1)["pattern_id"])
    j = j.select("*", F.get("hits", F.lit(0))["pattern_id"].alias("top1"), F.get("hits", F.lit(0))["score"].alias("top_score"),
                 pick.alias("pick"),
                 F.exists("hits", lambda h: h["pattern_id"] == F.col("gold_pattern")).alias("in_topk"))
    first = kinds.withColumnsRenamed({"pattern_id": "top1", "complaint_type": "top1_type"})
    second = kinds.withColumnsRenamed({"pattern_id": "pick", "complaint_type": "pick_type"})
    return j.join(first, "top1", "left").join(second, "pick", "left")


def parser_eval(p: DataFrame, gate: float) -> DataFrame:
    inside = F.col("in_domain")

    def share(cond: Column, among: Column) -> Column:
        return F.avg(F.when(among, F.coalesce(cond, F.lit(False)).cast("double")))

    none, low = F.col("pick").isNull(), F.col("top_score") < gate
    gold = F.col("pick") == F.col("gold_pattern")
    return p.agg(
        F.count_if(inside).alias("n"), F.count_if(~inside).alias("ood_n"),
        share(F.col("in_topk"), inside).alias("gold_in_topk"),
        share(F.col("top1_type") == F.col("gold_type"), inside).alias("retrieval_top1_category"),
        share(F.col("top1") == F.col("gold_pattern"), inside).alias("retrieval_top1_pattern"),
        share(F.col("pick_type") == F.col("gold_type"), inside).alias("pick_category"),
        share(gold, inside).alias("pick_pattern"),
        F.coalesce(share(gold, inside & F.col("in_topk")), F.lit(0.0)).alias("pick_given_in_topk"),
        share(~none & ~low, inside).alias("answered_both_gates"), share(none, inside).alias("pick_none"),
        share(low, ~inside).alias("ood_reject_cosine"), share(none, ~inside).alias("ood_reject_pick"),
        share(none | low, ~inside).alias("ood_reject_either"))


def selection_distributions(p: DataFrame) -> DataFrame:
    """How often each severity, sentiment and confidence was given to in-domain queries."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                      for c in ("severity", "sentiment", "confidence")])
    return (p.where("in_domain").select(F.explode(pairs).alias("p")).where(F.col("p.value").isNotNull())
            .groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n")))


def leaked_ood(p: DataFrame, gate: float) -> DataFrame:
    return p.where(~F.col("in_domain") & (F.col("top_score") >= gate) & F.col("pick").isNotNull()).select(
        "query_id", "pick", "pick_type", "top_score")
