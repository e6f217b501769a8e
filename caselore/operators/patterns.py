"""Patterns: counts of outcomes per label triple, tiers and close times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numbers import round_half_even
from ..functions.ranking import outcome_ranks, percentiles_of_counts
from ..session import materialise

PAGE = 1000


def assign_tier(share: Column, cases: Column) -> Column:
    """Takes the share before rounding: 0.89996 is not fast although it is shown as 0.9."""
    return (F.when((share >= V.FAST_SHARE) & (cases >= V.FAST_CASES), "fast_lookup")
            .when(share >= V.LIGHT_SHARE, "rag_light").otherwise("rag_core"))


def resolution_catalogue(tickets: DataFrame) -> DataFrame:
    return (tickets.groupBy("resolution_id", "resolution_description")
            .agg(F.count(F.lit(1)).alias("total_count")))


def outcome_counts(tickets: DataFrame) -> DataFrame:
    """Additive: counts of two batches can be summed."""
    return tickets.groupBy("pattern_id", *V.LABELS, "resolution_id").agg(F.count(F.lit(1)).alias("count"))


def close_counts(tickets: DataFrame) -> DataFrame:
    """How often each close time occurs per pattern; additive like the outcome counts."""
    return (tickets.where(F.col("close_hours").isNotNull())
            .groupBy("pattern_id", "close_hours").agg(F.count(F.lit(1)).alias("n")))


def sum_outcome_counts(*parts: DataFrame) -> DataFrame:
    return (_union(parts).groupBy("pattern_id", *V.LABELS, "resolution_id")
            .agg(F.sum("count").alias("count")))


def sum_close_counts(*parts: DataFrame) -> DataFrame:
    return _union(parts).groupBy("pattern_id", "close_hours").agg(F.sum("n").alias("n"))


def _union(parts) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pattern_volume(counts: DataFrame) -> DataFrame:
    """Per pattern: cases, distinct outcomes, share of the most frequent one (unrounded) and tier."""
    totals = counts.groupBy("pattern_id", *V.LABELS).agg(
        F.sum("count").alias("total_cases"),
        F.count(F.lit(1)).alias("n_resolutions"),
        F.max("count").alias("top1_count"),
    )
    share = F.col("top1_count") / F.col("total_cases")
    return totals.withColumns({"top1_raw": share, "tier": assign_tier(share, F.col("total_cases"))})


def close_percentiles(close: DataFrame) -> DataFrame:
    return percentiles_of_counts(close, ["pattern_id"], "close_hours", "n",
                                 {"median_close_hours": 0.5, "p90_close_hours": 0.9})


def pattern_table(counts: DataFrame, close: DataFrame) -> DataFrame:
    """The pattern table from the two additive count tables."""
    times = close_percentiles(close)
    return (pattern_volume(counts).join(times, "pattern_id", "left").select(
        "pattern_id", *V.LABELS, "total_cases", "n_resolutions",
        round_half_even(F.col("top1_raw"), 4).alias("top1_share"),
        "tier",
        round_half_even(F.col("median_close_hours"), 2).alias("median_close_hours"),
        round_half_even(F.col("p90_close_hours"), 2).alias("p90_close_hours"),
        "top1_raw"))


def joint_counts(tickets: DataFrame) -> DataFrame:
    """Tickets per (pattern, outcome, close time), written: one pass over the tickets that both count tables are sums of."""
    return materialise(tickets.groupBy("pattern_id", *V.LABELS, "resolution_id", "close_hours").agg(F.count(F.lit(1)).alias("n")), "joint")


def outcomes_of(joint: DataFrame) -> DataFrame:
    return joint.groupBy("pattern_id", *V.LABELS, "resolution_id").agg(F.sum("n").alias("count"))


def close_of(joint: DataFrame) -> DataFrame:
    return joint.where(F.col("close_hours").isNotNull()).groupBy("pattern_id", "close_hours").agg(F.sum("n").alias("n"))


def build_patterns(tickets: DataFrame) -> DataFrame:
    joint = joint_counts(tickets)
    return pattern_table(outcomes_of(joint), close_of(joint))


def outcome_table(counts: DataFrame) -> DataFrame:
    """One row per (pattern, outcome) with its share and rank: the flat form of the outcome distribution."""
    totals = counts.groupBy("pattern_id").agg(F.sum("count").alias("total_cases"))
    shared = (counts.select("pattern_id", "resolution_id", "count").join(totals, "pattern_id")
              .withColumn("share_raw", F.col("count") / F.col("total_cases"))
              .withColumn("share", round_half_even(F.col("share_raw"), 4)))
    return outcome_ranks(shared)


def nest_outcomes(ranked: DataFrame, page: int = PAGE) -> DataFrame:
    """Outcome lists, most frequent first, at most ``page`` entries per row.

    A pattern with more outcomes continues on the next ``page_no``, so no row and no task holds an unbounded list.
    """
    item = F.struct("rank", "resolution_id", "count", "share")
    paged = ranked.groupBy("pattern_id", F.floor((F.col("rank") - 1) / page).cast("int").alias("page_no")).agg(
        F.array_sort(F.collect_list(item)).alias("items"))
    return paged.select("pattern_id", "page_no", F.transform(
        "items", lambda x: F.struct(x["resolution_id"].alias("resolution_id"), x["count"].alias("count"),
                                    x["share"].alias("share"))).alias("resolution_dist"))


def global_dist(tickets: DataFrame) -> DataFrame:
    n = tickets.groupBy("resolution_id").agg(F.count(F.lit(1)).alias("n"))
    return shares(n, [])


def type_dist(tickets: DataFrame) -> DataFrame:
    n = tickets.groupBy("complaint_type", "resolution_id").agg(F.count(F.lit(1)).alias("n"))
    return shares(n, ["complaint_type"])


def shares(n: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        out = n.join(n.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
    else:
        out = n.withColumn("total", n.agg(F.sum("n")).scalar())
    return out.withColumn("share", F.col("n") / F.col("total")).drop("total")


def build_report(patterns: DataFrame) -> DataFrame:
    """Patterns and volume per tier, and how much of the volume has a mixed outcome (by the rounded share)."""
    total = F.sum("total_cases").alias("tickets")
    per_tier = []
    for t in ("fast_lookup", "rag_light", "rag_core"):
        per_tier += [F.count_if(F.col("tier") == t).alias(f"patterns_{t}"),
                     F.sum(F.when(F.col("tier") == t, F.col("total_cases")).otherwise(0)).alias(f"volume_{t}")]
    mixed = F.sum(F.when(F.col("top1_share") < 0.75, F.col("total_cases")).otherwise(0))
    return patterns.agg(
        F.count(F.lit(1)).alias("patterns"), total, *per_tier,
        round_half_even(mixed / F.sum("total_cases"), 4).alias("volume_share_top1_lt_075"),
        F.count_if(F.col("top1_share") >= 0.9).alias("patterns_top1_ge_09"))
