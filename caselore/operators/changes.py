"""Old state against new tickets: what is fresh, new, changed, drifted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as T
from ..functions.numbers import round_half_even
from ..functions.ranking import join_on
from .patterns import assign_tier

SHIP_KEYS = 1_000_000  # batch rows whose keys may be shipped to the state


def seen_keys(batch: DataFrame, state: DataFrame, key: str = "unique_key") -> DataFrame:
    """Keys of the batch that the state already holds.

    The batch is the small side: filtering the state by it lets Spark broadcast the batch keys instead of
    shuffling every key of the history.
    """
    keys = batch.select(key).distinct()
    return join_on(state.select(key), keys, [key], "left_semi").distinct()


def dedupe_against_state(batch: DataFrame, state: DataFrame, key: str = "unique_key",
                         dedupe_within_batch: bool = False) -> DataFrame:
    """Batch rows whose key the state does not hold. Repeats inside a batch stay unless asked otherwise.

    The batch is counted first. A small one is looked up in the state as in ``seen_keys``; beyond ``SHIP_KEYS`` rows its
    keys would only be shuffled on top of both tables, so batch and state keys meet at once.
    """
    rows = batch.select(key).count()
    if dedupe_within_batch:
        batch = batch.dropDuplicates([key])
    held = seen_keys(batch, state, key) if rows <= SHIP_KEYS else state.select(key)
    return join_on(batch, held, [key], "left_anti")


def leakage_check(test: DataFrame, train: DataFrame) -> DataFrame:
    per_key = test.groupBy("unique_key").agg(F.count(F.lit(1)).alias("n"))
    hit = seen_keys(test, train).withColumn("hit", F.lit(True))
    flagged = join_on(per_key, hit, ["unique_key"], "left")
    return flagged.agg(F.sum("n").alias("test_rows"),
                       F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("overlap"))


def _label(prefix: str = "") -> Column:
    return T.pattern_text(*[F.col(prefix + c) for c in V.LABELS])


def new_patterns(new: DataFrame, old: DataFrame) -> DataFrame:
    fresh = new.join(old.select("pattern_id"), "pattern_id", "left_anti")
    return fresh.select("pattern_id", F.concat(_label(), F.lit(" (n="), F.col("total_cases").cast("string"), F.lit(")"))
                        .alias("pattern"))


def _common(new: DataFrame, old: DataFrame) -> DataFrame:
    o = old.select("pattern_id", F.col("total_cases").alias("old_cases"), F.col("tier").alias("old_tier"),
                   F.col("top1_raw").alias("old_top1"))
    return new.join(o, "pattern_id")


def updated_patterns(new: DataFrame, old: DataFrame) -> DataFrame:
    return _common(new, old).where(F.col("total_cases") != F.col("old_cases")).select(
        "pattern_id", "old_cases", "total_cases")


def tier_changes(new: DataFrame, old: DataFrame, margin: float = 0.0) -> DataFrame:
    """Patterns whose tier changed. With a margin (off by default) a share moved by it must not give the old tier back."""
    changed = _common(new, old).where(F.col("tier") != F.col("old_tier"))
    if margin:
        nearer = [assign_tier(F.col("top1_raw") + d, F.col("total_cases")) for d in (-margin, margin)]
        changed = changed.where((nearer[0] != F.col("old_tier")) & (nearer[1] != F.col("old_tier")))
    return changed.select("pattern_id", _label().alias("pattern"), F.col("old_tier").alias("tier_from"),
                          F.col("tier").alias("tier_to"))


def batch_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """Every pattern a batch added, grew or moved, from one join: change is ``new``, ``tier`` or ``updated``."""
    o = old.select(F.col("pattern_id").alias("old_id"), F.col("total_cases").alias("old_cases"), F.col("tier").alias("tier_from"))
    j = new.join(o, F.col("pattern_id") == F.col("old_id"), "left")
    change = (F.when(F.col("old_id").isNull(), "new").when(F.col("tier") != F.col("tier_from"), "tier")
              .when(F.col("total_cases") != F.col("old_cases"), "updated"))
    named = F.concat(_label(), F.lit(" (n="), F.col("total_cases").cast("string"), F.lit(")"))
    return j.select(change.alias("change"), "pattern_id", F.when(change == "new", named).otherwise(_label()).alias("pattern"),
                    "tier_from", F.col("tier").alias("tier_to"), F.col("old_cases"), "total_cases").where("change is not null")


def tier_transitions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Before x after, including patterns absent on one side."""
    o = old.select("pattern_id", F.col("tier").alias("tier_before"))
    n = new.select("pattern_id", F.col("tier").alias("tier_after"))
    j = o.join(n, "pattern_id", "full_outer").fillna("absent", ["tier_before", "tier_after"])
    names = ["fast_lookup", "rag_light", "rag_core", "absent"]
    return j.groupBy("tier_before").agg(*[F.count_if(F.col("tier_after") == t).alias(t) for t in names])


def new_resolutions(tickets: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome templates never recorded before, with their tickets."""
    n = tickets.groupBy("resolution_id", "resolution_description").agg(F.count(F.lit(1)).alias("n"))
    return n.join(known.select("resolution_id"), "resolution_id", "left_anti")


def known_coverage(tickets: DataFrame, old: DataFrame) -> DataFrame:
    """How much of a batch falls into known patterns."""
    n = tickets.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(old.select("pattern_id", F.lit(True).alias("known")), "pattern_id", "left")
    return j.agg(F.sum("n").alias("tickets"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("in_known"),
                 F.count_if(F.col("known").isNull()).alias("new_patterns"),
                 (F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("known_share"))


def new_label_triples(tickets: DataFrame, old: DataFrame, top: int = 15) -> DataFrame:
    n = tickets.groupBy("pattern_id", *V.LABELS).agg(F.count(F.lit(1)).alias("n"))
    return (n.join(old.select("pattern_id"), "pattern_id", "left_anti")
            .orderBy(F.desc("n"), "pattern_id").limit(top).select(*V.LABELS, "n"))


def unseen_types(tickets: DataFrame, train: DataFrame) -> DataFrame:
    return tickets.select("complaint_type").distinct().join(
        train.select("complaint_type").distinct(), "complaint_type", "left_anti")


def attach_text(outcomes: DataFrame, resolutions: DataFrame) -> DataFrame:
    return outcomes.join(resolutions.select("resolution_id", F.col("resolution_description").alias("text")),
                         "resolution_id")


def tv_distance(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """Half the sum of |p - q| per key over all outcomes of either side.

    Both sides are stacked with opposite signs, so one partially aggregated groupBy replaces a full outer join.
    Inputs: ``keys, resolution_id, share``.
    """
    both = p.select(*keys, "resolution_id", F.col("share").alias("d")).unionByName(
        q.select(*keys, "resolution_id", (-F.col("share")).alias("d")))
    return (both.groupBy(*keys, "resolution_id").agg(F.sum("d").alias("d"))
            .groupBy(*keys).agg((F.sum(F.abs("d")) * 0.5).alias("tv")))


def busiest_known(tickets: DataFrame, old: DataFrame, top: int = 15) -> DataFrame:
    n = tickets.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("new_n"))
    return n.join(old.select("pattern_id"), "pattern_id", "left_semi").orderBy(F.desc("new_n"), "pattern_id").limit(top)


def outcome_shares(tickets: DataFrame, only: DataFrame | None = None) -> DataFrame:
    n = tickets.groupBy("pattern_id", "resolution_id").agg(F.count(F.lit(1)).alias("n"))
    if only is not None:
        n = n.join(only.select("pattern_id"), "pattern_id", "left_semi")
    total = n.groupBy("pattern_id").agg(F.sum("n").alias("total"))
    return n.join(total, "pattern_id").select("pattern_id", "resolution_id", (F.col("n") / F.col("total")).alias("share"))


def drift(train: DataFrame, batch: DataFrame, old: DataFrame, top: int = 15) -> DataFrame:
    """How far the outcomes of the busiest known patterns moved."""
    busy = busiest_known(batch, old, top)
    tv = tv_distance(outcome_shares(train, busy), outcome_shares(batch, busy), ["pattern_id"])
    return (busy.join(tv, "pattern_id").join(old, "pattern_id").select(
        "pattern_id", _label().alias("pattern"), F.col("total_cases").alias("train_n"), "new_n",
        round_half_even(F.round("tv", 9), 3).alias("tv_distance")))


def verdict_default(claims: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Claims without a verdict count as unsupported."""
    return claims.join(verdicts.select(*keys, "verdict", "reason"), keys, "left").withColumns({
        "verdict": F.coalesce("verdict", F.lit("unsupported")),
        "reason": F.coalesce("reason", F.lit("no verdict returned"))})


def shrunk_shares(counts: DataFrame, m: float = 10.0) -> DataFrame:
    """Shares of small patterns pulled toward the outcome shares of their complaint type (off by default)."""
    types = counts.groupBy("complaint_type", "resolution_id").agg(F.sum("count").alias("tn"))
    totals = types.groupBy("complaint_type").agg(F.sum("tn").alias("tt"))
    p_type = types.join(totals, "complaint_type").select(
        "complaint_type", "resolution_id", (F.col("tn") / F.col("tt")).alias("p_type"))
    n = counts.groupBy("pattern_id").agg(F.sum("count").alias("n"))
    j = counts.join(n, "pattern_id").join(p_type, ["complaint_type", "resolution_id"])
    return j.select("pattern_id", "resolution_id", "count",
                    ((F.col("count") + F.lit(float(m)) * F.col("p_type")) / (F.col("n") + F.lit(float(m)))).alias("share"))
