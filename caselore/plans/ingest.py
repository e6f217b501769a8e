"""Building and growing the state: the first load and every later batch."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.embed import Embed, hash_embed
from ..functions.numbers import round_half_even
from ..operators import changes as D
from ..operators import clean as C
from ..operators import patterns as P
from ..operators import vectors as X
from ..session import materialise
from ..sources import state as S
from ..sources.prefix_log import prefixes_for
from ..sources.tickets import check_columns, check_size, write_report

HASH_MODEL = "hashed-words"
LABEL_ONLY, WITH_EXAMPLES = "label only", "label + synthetic example complaints"


@dataclass
class BatchReport:
    summary: DataFrame  # one row
    new_patterns: DataFrame
    tier_changes: DataFrame


def _patterns_from(counts: DataFrame, times: DataFrame) -> DataFrame:
    return P.pattern_volume(counts).join(times, "pattern_id", "left").select(
        "pattern_id", *V.LABELS, "total_cases", "n_resolutions", round_half_even(F.col("top1_raw"), 4).alias("top1_share"),
        "tier", "median_close_hours", "p90_close_hours", "top1_raw")


def _times(close: DataFrame) -> DataFrame:
    return P.close_percentiles(close).withColumns({
        c: round_half_even(F.col(c), 2) for c in ("median_close_hours", "p90_close_hours")})


def init_state(spark: SparkSession, root: str, clean: DataFrame, examples: DataFrame | None = None,
               embed: Embed = hash_embed, model: str = HASH_MODEL, dim: int = V.EMBED_DIM) -> S.Snapshot:
    """Version 0 from clean tickets; the tickets are read once and everything else comes from what was written.

    A root that holds a committed state is refused: its folders are being read.
    """
    live = S.current(spark, root)
    if live is not None:
        raise ValueError(f"{root} already holds version {live.v}; load into a new root")
    attempt = S.new_attempt()
    tickets = S.put(clean, root, "tickets", 0, attempt)
    counts = S.put(P.outcome_counts(tickets), root, "outcome_counts", 0, attempt)
    prefixes = prefixes_for(tickets.count())
    keys = S.key_index(spark, root, prefixes).put(tickets)
    log = S.close_log(spark, root, prefixes)
    close = log.put(P.close_counts(tickets))
    patterns = S.put(_patterns_from(counts, _times(log.read(S.CLOSE_SCHEMA, of=[close]))), root, "patterns", 0, attempt)
    S.put(P.resolution_catalogue(tickets), root, "resolutions", 0, attempt)
    kept = None
    if examples is not None:
        kept = examples.join(patterns.select("pattern_id"), "pattern_id", "left_semi")
        kept.write.json(S.folder(root, "examples", 0, attempt))
    _write_vectors(patterns, kept, root, 0, attempt, embed, dim)
    S.commit(spark, root, 0, attempt, model, LABEL_ONLY if examples is None else WITH_EXAMPLES, dim, prefixes,
             [keys], [close])
    return S.current(spark, root)


def _write_vectors(patterns: DataFrame, examples: DataFrame | None, root: str, v: int, attempt: str, embed: Embed, dim: int):
    rows = X.index_rows(patterns, examples)
    out = X.check_dim(X.embed_rows(rows, embed), dim).select("vec_id", "pattern_id", "slot", "embedding")
    return S.put(out, root, "vectors", v, attempt)


def merged_patterns(old: DataFrame, counts: DataFrame, close: DataFrame, touched: DataFrame) -> DataFrame:
    """Pattern table after a batch: counts are additive, percentiles are recomputed for touched patterns only."""
    fresh = _times(P.sum_close_counts(close.join(touched, "pattern_id", "left_semi")))
    kept = old.join(touched, "pattern_id", "left_anti").select("pattern_id", "median_close_hours", "p90_close_hours")
    return _patterns_from(counts, fresh.unionByName(kept))


def apply_batch(spark: SparkSession, root: str, raw: DataFrame, examples: DataFrame | None = None,
                embed: Embed = hash_embed, model: str = HASH_MODEL, max_rows: int | None = None, tries: int = 5) -> BatchReport:
    """Add one batch of raw tickets. The same batch again adds nothing and writes no version.

    If another writer commits first, the batch is applied anew to the version that is there now, ``tries`` times at most.
    """
    t0 = time.perf_counter()
    check_columns(raw)
    # The raw batch is read once; the funnel, the key lookup and the fresh rows come from the repaired copy.
    repaired = materialise(C.flagged(raw), "repaired")
    funnel = C.count_flags(repaired).first()
    check_size(funnel.raw_rows, max_rows)
    for left in range(tries - 1, -1, -1):
        try:
            return _apply(spark, root, repaired, funnel, examples, embed, model, t0)
        except S.Conflict:
            if not left:
                raise


def _apply(spark: SparkSession, root: str, repaired: DataFrame, funnel, examples: DataFrame | None, embed: Embed, model: str,
           t0: float) -> BatchReport:
    old = S.current(spark, root)
    if old is None:
        raise ValueError(f"no state at {root}")
    X.guard_model(old.model_name, model)
    v, attempt = old.v + 1, S.new_attempt()
    usable = C.usable_tickets(repaired)
    tickets = S.put(old.keys.fresh(usable), root, "tickets", v, attempt)
    ingested = tickets.count()
    base = {"received": funnel.raw_rows, "usable": funnel.usable, "duplicates_skipped": funnel.usable - ingested,
            "ingested": ingested, "closed": funnel.closed, "with_resolution": funnel.with_resolution}
    old_patterns = old.patterns
    if ingested == 0:
        none = old_patterns.limit(0)
        extra = {"new_patterns": 0, "updated_patterns": 0, "tier_changes": 0, "new_resolutions": 0,
                 "examples_generated": 0, "index_vectors": old.vectors.count()}
        return BatchReport(_row(spark, {**base, **extra}, t0), D.new_patterns(none, none), D.tier_changes(none, none))

    counts = S.put(P.sum_outcome_counts(old.outcome_counts, P.outcome_counts(tickets)), root, "outcome_counts", v, attempt)
    delta = old.close.put(P.close_counts(tickets))
    touched = tickets.select("pattern_id").distinct()
    log = S.close_log(spark, root, old.prefixes, [*old.close_segments, delta])
    close = log.read(S.CLOSE_SCHEMA, log.touched(touched))
    patterns = S.put(merged_patterns(old_patterns, counts, close, touched), root, "patterns", v, attempt)
    resolutions = (old.resolutions.unionByName(P.resolution_catalogue(tickets))
                   .groupBy("resolution_id", "resolution_description").agg(F.sum("total_count").alias("total_count")))
    resolutions = S.put(resolutions, root, "resolutions", v, attempt)

    moved = S.put(D.batch_changes(patterns, old_patterns), root, "changes", v, attempt)
    new_rows = patterns.join(moved.where("change = 'new'").select("pattern_id"), "pattern_id", "left_semi")
    kept, generated = None, 0
    if examples is not None:
        kept = examples.join(new_rows.select("pattern_id"), "pattern_id", "left_semi")
        kept.write.json(S.folder(root, "examples", v, attempt))
        generated = kept.agg(F.coalesce(F.sum(F.size("complaints")), F.lit(0))).first()[0]
    vectors = _write_vectors(new_rows, kept, root, v, attempt, embed, old.dim)
    seen = moved.agg(F.count_if(F.col("change") == "new").alias("new"), F.count_if(F.col("change") == "tier").alias("tier"),
                     F.count_if(F.col("old_cases") != F.col("total_cases")).alias("updated")).first()
    extra = {
        "new_patterns": seen.new, "updated_patterns": seen.updated, "tier_changes": seen.tier,
        "new_resolutions": resolutions.join(old.resolutions, "resolution_id", "left_anti").count(),
        "examples_generated": generated, "index_vectors": old.vectors.count() + vectors.count()}
    report = BatchReport(_row(spark, {**base, **extra}, t0),
                         moved.where("change = 'new'").select("pattern_id", "pattern"),
                         moved.where("change = 'tier'").select("pattern_id", "pattern", "tier_from", "tier_to"))
    write_report(report.summary.withColumn("at", F.current_timestamp()).coalesce(1), S.folder(root, "audit", v, attempt))
    keys = old.keys.grown(old.keys.put(tickets), tickets.select(S.KEY).schema)
    S.commit(spark, root, v, attempt, model, old.doc_format if examples is None else WITH_EXAMPLES, old.dim,
             old.prefixes, keys, old.close.grown(delta, S.CLOSE_SCHEMA))
    return report


def _row(spark: SparkSession, values: dict, t0: float) -> DataFrame:
    cols = [F.lit(int(x)).cast("bigint").alias(k) for k, x in values.items()]
    return spark.range(1).select(*cols, F.lit(round(time.perf_counter() - t0, 2)).alias("seconds"))
