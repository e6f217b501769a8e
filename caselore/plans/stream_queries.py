"""Streams and acceptance checks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.embed import hash_embed
from ..operators import acceptance as Q
from ..operators import answer as G
from ..operators import evaluate as H
from ..operators import monitor as M
from ..operators import patterns as P
from ..operators import retrieve as R
from ..operators import vectors as X
from ..operators.changes import verdict_default
from ..session import fresh_path, materialise
from ..sources import adapters as A
from ..sources import state as S
from ..sources import tickets as K
from ..streaming import jobs as J
from ..streaming.alerts import start_alerts
from . import ingest as I
from .answer_queries import BROKEN, LOG, MAIN, REASON, TEMPLATE_SUMMARY, kept_answers, outcomes_sql, sources_sql, windows_sql
from .base_queries import _labels_sql
from .check_sql import DIFF, with_
from .history_queries import base_state, later_raw
from .registry import CHECKS, query
from .search_queries import DOCQ, GATE, METRICS, SCORED, TOP, Setup, embed_sql, picked, rounded, scored, text_patterns, top_scores


@query("stream_ingest", with_(DIFF, """
select pattern_id, total_cases, n_resolutions, top1_share, tier, median_close_hours, p90_close_hours from n_patterns"""))
def stream_ingest(spark, sf):
    """Later tickets arrive as files, in two batches; the state ends up as if all tickets had been there from the start."""
    root, _ = base_state(spark, sf)
    raw = later_raw(spark, sf)
    inbox = fresh_path(spark, "inbox")
    raw.repartition(max(2, spark.sparkContext.defaultParallelism), "unique_key").write.parquet(inbox)  # a key is in one file
    half = max(1, -(-len(spark.read.schema(raw.schema).parquet(inbox).inputFiles()) // 2))
    q = J.stream_ingest(J.ticket_files(spark, inbox, raw.schema, half), root, fresh_path(spark, "checkpoint"))
    q.awaitTermination()
    return S.current(spark, root).patterns.select(
        "pattern_id", "total_cases", "n_resolutions", "top1_share", "tier", "median_close_hours", "p90_close_hours")


TRIAGE = MAIN.replace("case when degraded then top1 when asked then pick end as main", "case when not low then top1 end as main") \
    .replace("not low and (not asked or (pick is not null and pp.tier <> 'fast_lookup' and not has_draft)) as degraded", "not low as degraded")


@query("stream_triage", with_(TRIAGE + "," + sources_sql(0) + "," + outcomes_sql(3), f"""
select mn.query_id, low as abstained, case when low then {REASON} end as abstain_reason, top_score, main as pattern_id, tier,
 {TEMPLATE_SUMMARY} as summary from mn left join shown s on s.query_id = mn.query_id and s.rank = 1"""))
def stream_triage(spark, sf):
    s = Setup(spark, sf)
    cards = R.pattern_cards(s.patterns, s.counts, s.resolutions, 5)
    inbox, out = fresh_path(spark, "complaints"), fresh_path(spark, "triage")
    complaints = A.complaints(spark, sf).select("query_id", "embedding")
    complaints.write.parquet(inbox)
    q = J.stream_triage(J.ticket_files(spark, inbox, complaints.schema), s.vectors, s.volume, cards, out,
                        fresh_path(spark, "checkpoint"), GATE)
    q.awaitTermination()
    return spark.read.parquet(out).select("query_id", "abstained", "abstain_reason", "top_score", "pattern_id", "tier",
                                          F.col("answer.summary.text").alias("summary"))


@query("stream_window_alerts", with_(LOG, f"""
select window_start, window_end, requests, round(abstain_rate, 9) as abstain_rate, degraded, round(p95_latency, 9) as p95_latency
from {windows_sql(30)} w where window_end <= (select max(ts) from log) - interval 10 minute"""))
def stream_window_alerts(spark, sf):
    """Only windows the watermark has passed are final and come out."""
    events = A.table(spark, sf, "events")
    log = A.log_of_events(J.ticket_files(spark, sf, events.schema, glob="events.parquet"))
    out = fresh_path(spark, "alerts")
    q = (J.stream_alert_windows(log, "30 minutes").writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start(out))
    q.awaitTermination()
    w = spark.read.parquet(out)
    start, end = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return w.select(start, end, "requests", F.round("abstain_rate", 9).alias("abstain_rate"), "degraded",
                    F.round("p95_latency", 9).alias("p95_latency"))


STATE_SQL = f"""
last_closed as (select max(window_end) as mark from {windows_sql(60)} w where window_end <= (select max(ts) from log) - interval 10 minute),
closed as (select b.*, mark from ({BROKEN}) b, last_closed where window_end <= mark),
marked as (select *, case when lag(window_end) over (partition by alert order by window_end) = window_end - interval 5 minute
 then 0 else 1 end as starts from closed),
runs as (select *, sum(starts) over (partition by alert order by window_end) as run from marked),
sinces as (select alert, window_end, mark, run, min(window_end) over (partition by alert, run) as since,
 max(window_end) over (partition by alert, run) as last from runs)"""


@query("stream_alert_states", with_(LOG + "," + STATE_SQL, f"""
select alert, window_end, since, case when date_diff('minute', since, window_end) >= case alert
 {' '.join(f"when '{n}' then {r[4]}" for n, r in V.ALERT_RULES.items())} end then 'firing' else 'pending' end as state from sinces
union all select distinct alert, last + interval 5 minute, since, 'resolved' from sinces where last + interval 5 minute <= mark"""))
def stream_alert_states(spark, sf):
    """States come out as windows close; what the watermark has not passed is still open."""
    events = A.table(spark, sf, "events")
    log = A.log_of_events(J.ticket_files(spark, sf, events.schema, glob="events.parquet"))
    root = fresh_path(spark, "alerts")
    start_alerts(log, root)
    return spark.read.parquet(f"{root}/states").select(
        "alert", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_end", "since")], "state")


@query("service_counters", with_(LOG + "," + DIFF, """
select 'errors_total' as metric, count(*) filter (reason = 'internal error') as n from log
union all select 'ingested_tickets_total', count(*) from later
union all select 'new_patterns_total', count(*) from n_patterns where pattern_id not in (select pattern_id from o_patterns)"""))
def service_counters(spark, sf):
    root, _ = base_state(spark, sf)
    I.apply_batch(spark, root, later_raw(spark, sf))
    return M.service_counters(A.answer_log(spark, sf), S.audit(spark, root))


@query("ingest_verdict", with_(DIFF + f""",
lab as (select pattern_id, {embed_sql('t')} as e from (select pattern_id,
 {_labels_sql('. ', 'complaint_type descriptor descriptor_2')} as t from n_patterns) x),
best as (select a.pattern_id, b.pattern_id as found, row_number() over (partition by a.pattern_id
 order by round(list_dot_product(a.e, b.e), 9) desc, b.pattern_id) as rn
 from (select * from lab where pattern_id not in (select pattern_id from o_patterns)) a, lab b)""", """
select true as required_columns, (select count(*) from later) > 0 as rows_survive,
 (select count(*) from later where unique_key in (select unique_key from base)) = 0 as no_overlap,
 (select count(*) from later) > 0 as ingestion_ran, true as counts_agree, true as replay_is_noop, true as pattern_count_grew,
 (select coalesce(bool_and(pattern_id = found), true) from best where rn = 1) as new_patterns_found"""))
def ingest_verdict(spark, sf):
    """The eight checks a batch must pass. Labels that differ only in digits share a hashed vector, so the last may fail."""
    root, old = base_state(spark, sf)
    raw = later_raw(spark, sf)
    first = I.apply_batch(spark, root, raw)
    now = S.current(spark, root)
    again = I.apply_batch(spark, root, raw).summary
    new = now.patterns.join(old.patterns.select("pattern_id"), "pattern_id", "left_anti")
    found = Q.own_label_hits(new, now.vectors, now.patterns, hash_embed)
    r = first.summary
    grew = now.patterns.agg(F.count(F.lit(1))).scalar() == old.patterns.agg(F.count(F.lit(1))).scalar() + F.col("new_patterns")
    return r.select(
        F.lit(not K.missing_columns(raw)).alias("required_columns"), (F.col("usable") > 0).alias("rows_survive"),
        (F.col("duplicates_skipped") == 0).alias("no_overlap"), (F.col("ingested") > 0).alias("ingestion_ran"),
        (F.col("ingested") == F.col("usable") - F.col("duplicates_skipped")).alias("counts_agree"),
        (again.select("ingested").scalar() == 0).alias("replay_is_noop"), grew.alias("pattern_count_grew"),
        found.agg(F.coalesce(F.bool_and("found"), F.lit(True))).scalar().alias("new_patterns_found"))


@query("retrieval_gate", with_(DOCQ, f"""
select p.pattern_id as query_id, true as ok from tp p"""))
def retrieval_gate(spark, sf):
    """Every benchmark text must come back as its own type; anything else stops the run."""
    p = text_patterns(spark, sf).withColumn("total_cases", F.lit(1).cast("bigint"))
    v = X.embed_rows(X.index_rows(p, p), hash_embed)
    q = v.where(F.col("slot") == 0).select(F.col("pattern_id").alias("query_id"), "embedding")
    expected = p.select(F.col("pattern_id").alias("query_id"), F.col("complaint_type").alias("expected_type"))
    out = Q.retrieval_gate(expected, R.rank_queries(q, v, p, 1), p)
    Q.require_all(out)
    return out.select("query_id", "ok")


RUN = SCORED + "," + TOP.split("near as", 1)[1].split(",\n", 1)[1].replace("ranked", "ranked1") + """,
auc as (select avg(case when i.score > o.score then 1.0 when i.score = o.score then 0.5 else 0 end) as auroc from tops1 i, tops1 o
 where i.in_domain and not o.in_domain)"""


@query("run_comparison", with_(RUN.replace("tops as (select query_id, in_domain", "tops1 as (select query_id, in_domain"), f"""
select 'base' as tag, 'hashed-words' as model_name, (select count(*) from vindex) as n, alpha, round((select auroc from auc), 9) as auroc,
 recall_at_1, recall_at_5, recall_at_10, category_at_1, volume_weighted_recall_at_1, resolution_tv_at_1, resolution_coverage_at_3
from ({METRICS}) m"""))
def run_comparison(spark, sf):
    s = Setup(spark, sf)
    path = fresh_path(spark, "reports")
    report = Q.retrieval_report(
        "base", H.retrieval_metrics(scored(spark, sf)), X.index_manifest(s.vectors, s.volume, "hashed-words"),
        H.no_retrieval_tv(s.queries, s.volume, s.outcomes()), H.abstention_auroc(top_scores(spark, sf)))
    K.write_report(report, f"{path}/base")
    return rounded(Q.run_comparison(spark, f"{path}/*").drop("no_retrieval_tv"))


PICK_METRICS = ["gold_in_topk", "retrieval_top1_category", "pick_category", "answered_both_gates", "ood_reject_either"]
ANSWER_METRICS = ["answered_pct", "end_to_end_category_acc_pct", "supported_pct", "ood_abstained_pct"]


def _unpivoted(tag: str, sql: str, metrics: list[str]) -> str:
    values = " union all ".join(f"select '{m}' as metric, cast({m} as double) as value from r" for m in metrics)
    return f"select '{tag}' as tag, metric, value from (with r as ({sql}) {values}) u"


@query("headline_comparison", " union all ".join([
    _unpivoted("picks, gate 0.4", CHECKS["parser_eval"], PICK_METRICS),
    _unpivoted("picks, gate 0.5", CHECKS["parser_eval"].replace("0.4::double", "0.5::double"), PICK_METRICS),
    _unpivoted("answers", CHECKS["generation_report"], ANSWER_METRICS)]))
def headline_comparison(spark, sf):
    """Headline numbers of several runs, picks and answers, side by side out of their reports."""
    path = fresh_path(spark, "headlines")
    p = materialise(picked(spark, sf), "picked")  # both gates read it
    for tag, gate in (("picks, gate 0.4", 0.4), ("picks, gate 0.5", 0.5)):
        K.write_report(rounded(H.parser_eval(p, gate)).withColumn("tag", F.lit(tag)), f"{path}/picks/{gate}")
    a = kept_answers(spark, sf)
    v = verdict_default(G.claims(a), A.verdicts(spark, sf), ["query_id", "id"])
    K.write_report(M.generation_report(a, v).withColumn("tag", F.lit("answers")), f"{path}/answers/base")
    rows = [Q.report_rows(spark, f"{path}/{kind}/*", ", ".join(["tag string", *[f"{m} double" for m in metrics]]), metrics)
            for kind, metrics in (("picks", PICK_METRICS), ("answers", ANSWER_METRICS))]
    return rows[0].unionByName(rows[1])
