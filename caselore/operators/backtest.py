"""Temporal backtest: how much probability did the history give to what happened later?

Every value of a later ticket depends only on its pattern and its outcome. The lookups therefore run on the distinct
(pattern, outcome) pairs of the test tickets; a pattern that owns most tickets is one small set of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numbers import round_half_even, support_bucket
from ..functions.ranking import join_on
from ..session import materialise
from . import patterns as P
from .changes import dedupe_against_state

SHIP_LIMIT = 64 << 20
PARTS = 1000
VALUES = ["seen", "type_seen", "res_seen", "p_pattern", "p_type", "p_global", "top1", "top3", "tier", "train_n",
          "pred_top1_share"]


def history_counts(train: DataFrame) -> DataFrame:
    """The tickets per (pattern, outcome), written: the history is read once and every lookup is a sum of these rows."""
    return materialise(P.outcome_counts(train), "history")


def _shares(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Share of each outcome per key (overall without keys), out of the counts."""
    per = counts.groupBy(*keys, "resolution_id").agg(F.sum("count").alias("n"))
    return P.shares(per, keys).select(*keys, "resolution_id", F.col("share").alias(name))


def scored_pairs(counts: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct (pattern, outcome) pairs of the test tickets with their count and all backtest values.

    ``counts`` is ``history_counts`` of the training tickets.
    """
    pairs = test.groupBy("pattern_id", "complaint_type", "resolution_id").agg(F.count(F.lit(1)).alias("n"))
    known = P.pattern_volume(counts).select(
        "pattern_id", F.lit(True).alias("seen"), "tier", F.col("total_cases").alias("train_n"),
        round_half_even(F.col("top1_raw"), 4).alias("pred_top1_share"))
    ranked = P.outcome_table(counts).select("pattern_id", "resolution_id", F.col("share").alias("p_pattern"), "rank")
    by_type = _shares(counts, ["complaint_type"], "p_type")
    types = counts.select("complaint_type").distinct().withColumn("type_seen", F.lit(True))
    overall = _shares(counts, [], "p_global")
    j = (pairs.join(known, "pattern_id", "left").join(ranked, ["pattern_id", "resolution_id"], "left")
         .join(types, "complaint_type", "left").join(by_type, ["complaint_type", "resolution_id"], "left")
         .join(overall, "resolution_id", "left"))
    seen = F.coalesce("seen", F.lit(False))
    return j.select(
        "pattern_id", "resolution_id", "n", seen.alias("seen"), F.coalesce("type_seen", F.lit(False)).alias("type_seen"),
        F.col("p_global").isNotNull().alias("res_seen"),
        F.when(seen, F.coalesce("p_pattern", F.lit(0.0))).alias("p_pattern"),
        F.coalesce("p_type", F.lit(0.0)).alias("p_type"), F.coalesce("p_global", F.lit(0.0)).alias("p_global"),
        F.when(seen, F.coalesce(F.col("rank") == 1, F.lit(False))).alias("top1"),
        F.when(seen, F.coalesce(F.col("rank") <= 3, F.lit(False))).alias("top3"),
        F.coalesce("tier", F.lit("new_pattern")).alias("tier"), F.coalesce("train_n", F.lit(0)).alias("train_n"),
        "pred_top1_share")


def backtest_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row per later ticket; tickets already in the history are skipped."""
    test = dedupe_against_state(test, train).select("unique_key", "pattern_id", "complaint_type", "resolution_id")
    test = materialise(test, "later")  # read for the pairs, and again for the rows
    pairs = materialise(scored_pairs(history_counts(train), test), "pairs")
    return with_pairs(test.drop("complaint_type"), pairs).select("unique_key", "pattern_id", *VALUES)


def with_pairs(rows: DataFrame, pairs: DataFrame, ship_limit: int = SHIP_LIMIT, parts: int = PARTS) -> DataFrame:
    """Every row with the values of its (pattern, outcome); ``pairs`` has each pair once, with the rows ``n`` that it has.

    The pairs are measured: a small table is shipped and the rows stay where they are. Beyond that both sides are
    shuffled, and a pair with more than a ``parts``-th of all rows - there are fewer than ``parts`` of them - is copied
    for as many salts as it holds such parts, so that no task gets more than one part of it.
    """
    keys = ["pattern_id", "resolution_id"]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in (*keys, "tier")), F.lit(100))
    size = pairs.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    values = pairs.drop("n")
    if size["bytes"] <= ship_limit:
        return join_on(rows, F.broadcast(values), keys)
    part = max(size["rows"] // parts, 1)
    hot = pairs.where(F.col("n") > part).select(*keys, F.ceil(F.col("n") / part).cast("int").alias("salts"))
    hot = F.broadcast(materialise(hot, "hot"))  # fewer than ``parts`` rows
    salted = join_on(rows, hot, keys, "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("unique_key"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    copied = join_on(values, hot, keys, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return join_on(salted, copied.hint("shuffle_merge"), [*keys, "salt"]).drop("salt")


def _means(d: DataFrame, keys: list[str]) -> DataFrame:
    def mean(c):
        x = F.col(c).cast("double")
        return round_half_even(F.round(F.sum(x * F.col("n")) / F.sum(F.when(x.isNotNull(), F.col("n"))), 9), 4)

    return d.groupBy(*keys).agg(
        F.sum("n").alias("n"), mean("p_pattern").alias("mean_p_pattern"), mean("p_type").alias("mean_p_type"),
        mean("p_global").alias("mean_p_global"), mean("top1").alias("top1_acc"), mean("top3").alias("top3_cov"),
        mean("pred_top1_share").alias("mean_predicted_top1_share"))


def backtest_summary(train: DataFrame, test: DataFrame) -> DataFrame:
    """Means over the tickets of known patterns: overall, by tier, by support. One pass over the weighted pairs."""
    s = scored_pairs(history_counts(train), dedupe_against_state(test, train)).where("seen")
    views = F.array(
        F.struct(F.lit("overall").alias("part"), F.lit("overall").alias("bucket")),
        F.struct(F.lit("tier").alias("part"), F.col("tier").alias("bucket")),
        F.struct(F.lit("support").alias("part"), support_bucket(F.col("train_n"), V.SUPPORT_BUCKETS).alias("bucket")))
    return _means(s.withColumn("view", F.explode(views)).select("*", "view.*"), ["part", "bucket"])


def backtest_totals(train: DataFrame, test: DataFrame) -> DataFrame:
    counts = history_counts(train)
    s = scored_pairs(counts, dedupe_against_state(test, train))

    def share(c):
        return round_half_even(100 * F.sum(F.when(F.col(c), F.col("n")).otherwise(0)) / F.sum("n"), 2)

    out = s.agg(F.sum("n").alias("test_tickets"), share("seen").alias("pattern_seen_pct"),
                share("type_seen").alias("complaint_type_seen_pct"), share("res_seen").alias("resolution_template_seen_pct"),
                F.countDistinct(F.when(~F.col("seen"), F.col("pattern_id"))).alias("new_patterns"))
    return out.withColumn("train_tickets", counts.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar())
