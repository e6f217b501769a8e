"""Sources, batches against the state, ingestion, backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as T
from ..operators import backtest as B
from ..operators import changes as D
from ..operators import clean as C
from ..operators import patterns as P
from ..session import fresh_path
from ..sources import state as S
from ..sources import tickets as K
from ..sources.adapters import CUTOFF, table, tickets_export, tickets_raw
from . import ingest as I
from .base_queries import _labels_sql, clean, clean_from_raw
from .check_sql import CLEAN, DIFF, EXPORT, RAW, SPLIT, with_
from .registry import query


def before_cutoff():
    return F.col("created_date") < F.lit(CUTOFF).cast("timestamp_ntz")


def split(spark, sf):
    t = clean(spark, sf)
    return t.where(before_cutoff()), t.where(~before_cutoff())


def patterns_of(t):
    return P.pattern_volume(P.outcome_counts(t))


def later_raw(spark, sf):
    return tickets_raw(spark, sf).where(C.to_time(F.col("created_date")) >= F.lit(CUTOFF).cast("timestamp_ntz"))


# --- sources ---


@query("read_tickets_csv", with_(RAW, """
select unique_key, created_date, closed_date, complaint_type, descriptor, descriptor_2,
 case when resolution_description = 'n/a' then null else resolution_description end as resolution_description from raw"""))
def read_tickets_csv(spark, sf):
    path = fresh_path(spark, "tickets-csv")
    K.write_csv(tickets_raw(spark, sf), path, V.REQUIRED)
    return K.read_tickets_csv(spark, path, V.REQUIRED)


@query("write_csv", with_(EXPORT, """
select unique_key, created_date, closed_date, complaint_type, descriptor, descriptor_2, resolution_description
from export where status = 'Closed'"""))
def write_csv(spark, sf):
    path = fresh_path(spark, "closed-csv")
    e = tickets_export(spark, sf)
    K.write_csv(e.where(C.is_closed(e)), path, V.REQUIRED)
    return K.read_tickets_csv(spark, path, V.REQUIRED)


@query("source_pushdown", with_(EXPORT, """
select unique_key, created_date, closed_date, complaint_type, descriptor, descriptor_2, resolution_description from export
where status = 'Closed' and resolution_description is not null and created_date >= '1998-01-01'
 and created_date < '1999-01-01'"""))
def source_pushdown(spark, sf):
    d = K.closed_between(tickets_export(spark, sf), "1998-01-01", "1999-01-01")
    return K.oldest_first(d, None)


@query("date_bounded_pull", with_(EXPORT, """
select * from export where created_date >= '1999-06-01' order by created_date, unique_key limit 100000"""))
def date_bounded_pull(spark, sf):
    return K.oldest_first(K.created_from(tickets_export(spark, sf), "1999-06-01"), 100_000)


@query("capped_pull", with_(EXPORT, """
select * from export where created_date >= '1995-01-01' order by created_date, unique_key limit 5000"""))
def capped_pull(spark, sf):
    """The same with a cap that cuts."""
    return K.oldest_first(K.created_from(tickets_export(spark, sf), "1995-01-01"), 5_000)


@query("schema_contract", with_(RAW, "select 0::bigint as missing, 3::bigint as extra_columns, count(*) as records from raw"))
def schema_contract(spark, sf):
    raw = tickets_raw(spark, sf)
    got = K.check_contract(raw, max_rows=None)
    return raw.agg(F.lit(len(got["missing"])).cast("bigint").alias("missing"),
                   F.lit(got["extra_columns"]).cast("bigint").alias("extra_columns"), F.count(F.lit(1)).alias("records"))


def examples_of(spark, sf):
    """Example complaints per benchmark text: its sentences."""
    b = table(spark, sf, "benchmark")
    return b.select(T.identity_hash(F.lit("TEXT"), F.col("item_id").cast("string"), F.lit("")).alias("pattern_id"),
                    F.split("text", r"\. ").alias("complaints"))


@query("read_examples", """
select substr(sha1('TEXT' || chr(31) || item_id || chr(31)), 1, 10) as pattern_id, len(string_split(text, '. ')) as n,
 md5(array_to_string(string_split(text, '. '), '|')) as complaints_md5 from benchmark where length(text) > 200""")
def read_examples(spark, sf):
    path = fresh_path(spark, "examples")
    K.append_json(examples_of(spark, sf), path)
    known = table(spark, sf, "benchmark").where(F.length("text") > 200).select(
        T.identity_hash(F.lit("TEXT"), F.col("item_id").cast("string"), F.lit("")).alias("pattern_id"))
    ex = K.read_examples(spark, path, known)
    return ex.select("pattern_id", F.size("complaints").cast("bigint").alias("n"),
                     F.md5(F.array_join("complaints", "|")).alias("complaints_md5"))


@query("append_examples", """
select substr(sha1('TEXT' || chr(31) || item_id || chr(31)), 1, 10) as pattern_id, 2::bigint as written from benchmark""")
def append_examples(spark, sf):
    path = fresh_path(spark, "examples")
    K.append_json(examples_of(spark, sf), path)
    K.append_json(examples_of(spark, sf), path)
    return K.read_examples(spark, path).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("written"))


@query("read_lines", """
select count(*) as n, sum(length(line))::bigint as chars from (select unnest(string_split(text, chr(10))) as line
 from conversations) t where trim(line) <> ''""")
def read_lines(spark, sf):
    path = fresh_path(spark, "lines")
    table(spark, sf, "conversations").select("text").write.text(path)
    return K.read_lines(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


@query("resume_todo", with_(DIFF, """
select pattern_id, total_cases from n_patterns where pattern_id not in (select pattern_id from o_patterns)"""))
def resume_todo(spark, sf):
    t = clean(spark, sf)
    done = t.where(before_cutoff()).select("pattern_id").distinct()
    return K.resume_todo(patterns_of(t).select("pattern_id", "total_cases"), done, "pattern_id")


@query("write_report", with_(CLEAN, "select count(*) as tickets, count(distinct pattern_id) as patterns from clean"))
def write_report(spark, sf):
    path = fresh_path(spark, "report")
    per = clean(spark, sf).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    K.write_report(per.agg(F.sum("n").alias("tickets"), F.count(F.lit(1)).alias("patterns")), path)
    return spark.read.schema("tickets long, patterns long").json(path)


# --- batches against the state ---


@query("dedupe_against_state", with_(SPLIT, """
select unique_key, pattern_id from clean where unique_key not in (select unique_key from base)"""))
def dedupe_against_state(spark, sf):
    base, _ = split(spark, sf)
    return D.dedupe_against_state(clean(spark, sf), base).select("unique_key", "pattern_id")


@query("leakage_check", with_(SPLIT, """
select count(*) as test_rows, count(*) filter (unique_key in (select unique_key from base)) as overlap from clean"""))
def leakage_check(spark, sf):
    base, _ = split(spark, sf)
    return D.leakage_check(clean(spark, sf), base)


NEW_LABEL = _labels_sql(". ", "n.complaint_type n.descriptor n.descriptor_2")


@query("new_patterns", with_(DIFF, f"""
select n.pattern_id, {NEW_LABEL} || ' (n=' || n.total_cases || ')' as pattern from n_patterns n
where pattern_id not in (select pattern_id from o_patterns)"""))
def new_patterns(spark, sf):
    return D.new_patterns(patterns_of(clean(spark, sf)), patterns_of(split(spark, sf)[0]))


@query("updated_patterns", with_(DIFF, """
select n.pattern_id, o.total_cases as old_cases, n.total_cases from n_patterns n join o_patterns o using (pattern_id)
where n.total_cases <> o.total_cases"""))
def updated_patterns(spark, sf):
    return D.updated_patterns(patterns_of(clean(spark, sf)), patterns_of(split(spark, sf)[0]))


@query("tier_changes", with_(DIFF, f"""
select n.pattern_id, {NEW_LABEL} as pattern, o.tier as tier_from, n.tier as tier_to from n_patterns n
join o_patterns o on n.pattern_id = o.pattern_id where n.tier <> o.tier"""))
def tier_changes(spark, sf):
    return D.tier_changes(patterns_of(clean(spark, sf)), patterns_of(split(spark, sf)[0]))


def _tier_sql(share: str) -> str:
    return f"""case when {share} >= 0.9::double and n.total_cases >= 30 then 'fast_lookup'
 when {share} >= 0.5 then 'rag_light' else 'rag_core' end"""


@query("tier_hysteresis", with_(DIFF, f"""
select n.pattern_id, {NEW_LABEL} as pattern, o.tier as tier_from, n.tier as tier_to from n_patterns n
join o_patterns o on n.pattern_id = o.pattern_id where n.tier <> o.tier
and {_tier_sql('(n.top1_raw + 0.02::double)')} <> o.tier and {_tier_sql('(n.top1_raw - 0.02::double)')} <> o.tier"""))
def tier_hysteresis(spark, sf):
    return D.tier_changes(patterns_of(clean(spark, sf)), patterns_of(split(spark, sf)[0]), margin=0.02)


@query("tier_transition_matrix", with_(DIFF, """
select coalesce(o.tier, 'absent') as tier_before, count(*) filter (n.tier = 'fast_lookup') as fast_lookup,
 count(*) filter (n.tier = 'rag_light') as rag_light, count(*) filter (n.tier = 'rag_core') as rag_core,
 count(*) filter (n.tier is null) as absent from o_patterns o full outer join n_patterns n on o.pattern_id = n.pattern_id
group by 1"""))
def tier_transition_matrix(spark, sf):
    return D.tier_transitions(patterns_of(clean(spark, sf)), patterns_of(split(spark, sf)[0]))


@query("new_resolutions", with_(SPLIT, """
select resolution_id, resolution_description, count(*) as n from later
where resolution_id not in (select resolution_id from base) group by 1, 2"""))
def new_resolutions(spark, sf):
    base, later = split(spark, sf)
    return D.new_resolutions(later, P.resolution_catalogue(base))


@query("known_pattern_coverage", with_(SPLIT, """
select count(*) as tickets, count(*) filter (k) as in_known, count(distinct pattern_id) filter (not k) as new_patterns,
 count(*) filter (k) / count(*)::double as known_share from (select *, pattern_id in (select pattern_id from o_patterns) as k
 from later) t"""))
def known_pattern_coverage(spark, sf):
    base, later = split(spark, sf)
    return D.known_coverage(later, patterns_of(base))


@query("new_label_triples", with_(SPLIT, """
select complaint_type, descriptor, descriptor_2, count(*) as n from later
where pattern_id not in (select pattern_id from o_patterns) group by 1, 2, 3, pattern_id order by n desc, pattern_id limit 15"""))
def new_label_triples(spark, sf):
    base, later = split(spark, sf)
    return D.new_label_triples(later, patterns_of(base))


@query("unseen_types", with_(SPLIT, """
select distinct complaint_type from later where complaint_type not in (select complaint_type from base)"""))
def unseen_types(spark, sf):
    base, later = split(spark, sf)
    return D.unseen_types(later, base)


@query("attach_resolution_text", with_(DIFF, """
select pattern_id, o.resolution_id, n as count, resolution_description as text from n_outcomes o
join n_catalogue c on o.resolution_id = c.resolution_id"""))
def attach_resolution_text(spark, sf):
    t = clean(spark, sf)
    o = P.outcome_counts(t).select("pattern_id", "resolution_id", "count")
    return D.attach_text(o, P.resolution_catalogue(t))


@query("tv_distance", with_(SPLIT + """,
b as (select pattern_id, resolution_id, count(*) / (sum(count(*)) over (partition by pattern_id))::double as p from later group by 1, 2)""", """
select pattern_id, round(0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 9) as tv from (
 select pattern_id, resolution_id, share_raw as p from o_outcomes where pattern_id in (select pattern_id from b)) a
full outer join (select * from b where pattern_id in (select pattern_id from o_outcomes)) b
using (pattern_id, resolution_id) group by 1"""))
def tv_distance(spark, sf):
    base, later = split(spark, sf)
    a = D.outcome_shares(base, later.select("pattern_id").distinct())
    b = D.outcome_shares(later, base.select("pattern_id").distinct())
    return D.tv_distance(a, b, ["pattern_id"]).withColumn("tv", F.round("tv", 9))


@query("append_union", with_(SPLIT, """
select unique_key, pattern_id, 'state' as part from base union all select unique_key, pattern_id, 'batch' from later"""))
def append_union(spark, sf):
    base, later = split(spark, sf)
    return base.withColumn("part", F.lit("state")).unionByName(later.withColumn("part", F.lit("batch"))).select(
        "unique_key", "pattern_id", "part")


@query("verdict_default_join", """
select c.conv_id, c.turn, coalesce(v.verdict, 'unsupported') as verdict, coalesce(v.reason, 'no verdict returned') as reason
from conversations c left join (select conv_id, turn, case when length(text) % 3 = 0 then 'partial' else 'supported' end
 as verdict, 'checked against the sources' as reason from conversations where role = 'user') v
on c.conv_id = v.conv_id and c.turn = v.turn""")
def verdict_default_join(spark, sf):
    c = table(spark, sf, "conversations")
    v = c.where("role = 'user'").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, "partial")
                                        .otherwise("supported").alias("verdict"),
                                        F.lit("checked against the sources").alias("reason"))
    return D.verdict_default(c.select("conv_id", "turn"), v, ["conv_id", "turn"])


@query("top_patterns_in_batch", with_(SPLIT, """
select pattern_id, count(*) as new_n from later where pattern_id in (select pattern_id from o_patterns) group by 1
order by new_n desc, pattern_id limit 15"""))
def top_patterns_in_batch(spark, sf):
    base, later = split(spark, sf)
    return D.busiest_known(later, patterns_of(base))


@query("drift_by_pattern", with_(SPLIT + """,
busy as (select pattern_id, count(*) as new_n from later where pattern_id in (select pattern_id from o_patterns) group by 1
 order by new_n desc, pattern_id limit 15),
b as (select pattern_id, resolution_id, count(*) / (sum(count(*)) over (partition by pattern_id))::double as p from later
 where pattern_id in (select pattern_id from busy) group by 1, 2),
a as (select pattern_id, resolution_id, share_raw as p from o_outcomes where pattern_id in (select pattern_id from busy)),
tv as (select pattern_id, round(0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 9) as tv from a full outer join b
 using (pattern_id, resolution_id) group by 1)""", f"""
select n.pattern_id, {NEW_LABEL} as pattern, n.total_cases as train_n, new_n, format('{{:.3f}}', tv)::double as tv_distance
from busy join tv using (pattern_id) join o_patterns n on n.pattern_id = busy.pattern_id"""))
def drift_by_pattern(spark, sf):
    base, later = split(spark, sf)
    return D.drift(base, later, patterns_of(base))


# --- ingestion ---


@query("temporal_split_replay", with_(SPLIT, """
select count(*) filter (created_date < timestamp '2000-07-01') as base_rows,
 count(*) filter (created_date >= timestamp '2000-07-01') as batch_rows from clean"""))
def temporal_split_replay(spark, sf):
    return clean(spark, sf).agg(F.count_if(before_cutoff()).alias("base_rows"), F.count_if(~before_cutoff()).alias("batch_rows"))


def base_state(spark, sf):
    """A state with the tickets before the cutoff, cleaned and written once: its own table is the one they are read from."""
    root = fresh_path(spark, "state")
    return root, I.init_state(spark, root, clean_from_raw(spark, sf).where(before_cutoff()))


@query("init_state", with_(SPLIT, """
select (select count(*) from base) as tickets, count(*) as patterns, count(*) as vectors from o_patterns"""))
def init_state(spark, sf):
    _, snap = base_state(spark, sf)
    return snap.tickets.agg(F.count(F.lit(1)).alias("tickets"),
                            snap.patterns.agg(F.count(F.lit(1))).scalar().alias("patterns"),
                            snap.vectors.agg(F.count(F.lit(1))).scalar().alias("vectors"))


@query("apply_batch", with_(DIFF, """
select (select count(*) from raw where try_cast(created_date as timestamp) >= timestamp '2000-07-01') as received,
 (select count(*) from later) as usable, 0::bigint as duplicates_skipped, (select count(*) from later) as ingested,
 (select count(*) from raw where try_cast(created_date as timestamp) >= timestamp '2000-07-01' and status = 'Closed') as closed,
 (select count(*) from raw where try_cast(created_date as timestamp) >= timestamp '2000-07-01' and status = 'Closed'
  and resolution_description <> 'n/a') as with_resolution,
 (select count(*) from n_patterns where pattern_id not in (select pattern_id from o_patterns)) as new_patterns,
 (select count(*) from n_patterns n join o_patterns o using (pattern_id) where n.total_cases <> o.total_cases) as updated_patterns,
 (select count(*) from n_patterns n join o_patterns o using (pattern_id) where n.tier <> o.tier) as tier_changes,
 (select count(*) from n_catalogue where resolution_id not in (select resolution_id from o_catalogue)) as new_resolutions,
 0::bigint as examples_generated, (select count(*) from n_patterns) as index_vectors"""))
def apply_batch(spark, sf):
    root, _ = base_state(spark, sf)
    return I.apply_batch(spark, root, later_raw(spark, sf)).summary.drop("seconds")


@query("audit", with_(DIFF, f"""
select n.pattern_id, case when o.pattern_id is null then 'new' else 'tier' end as change,
 {NEW_LABEL} || case when o.pattern_id is null then ' (n=' || n.total_cases || ')' else '' end as pattern,
 o.tier as tier_from, n.tier as tier_to,
 (select count(*) from raw where try_cast(created_date as timestamp) >= timestamp '2000-07-01') as received,
 (select count(*) from later) as usable
from n_patterns n left join o_patterns o on n.pattern_id = o.pattern_id where o.pattern_id is null or n.tier <> o.tier"""))
def audit(spark, sf):
    """What the audit of a batch holds: the cleaning funnel, every new pattern and every change of tier."""
    root, _ = base_state(spark, sf)
    I.apply_batch(spark, root, later_raw(spark, sf))
    row = S.audit(spark, root).select(F.col("v").alias("of"), "received", "usable")
    moved = S.audit_changes(spark, root).where("change in ('new', 'tier')")
    return moved.join(F.broadcast(row), F.col("v") == F.col("of")).select(  # one row per batch
        "pattern_id", "change", "pattern", "tier_from", "tier_to", "received", "usable")


@query("state_reinit", with_(SPLIT, """
select (select count(*) from base) as tickets, (select count(*) from o_patterns) as patterns, true as refused"""))
def state_reinit(spark, sf):
    """A second first load is refused and the state stays as it was."""
    root, _ = base_state(spark, sf)
    try:
        I.init_state(spark, root, clean_from_raw(spark, sf).where(~before_cutoff()))
        refused = False
    except ValueError:
        refused = True
    now = S.current(spark, root)
    return now.tickets.agg(F.count(F.lit(1)).alias("tickets"), now.patterns.agg(F.count(F.lit(1))).scalar().alias("patterns"),
                           F.lit(refused).alias("refused"))


@query("read_state", with_(DIFF, """
select pattern_id, complaint_type, descriptor, descriptor_2, total_cases, n_resolutions, top1_share, tier,
 median_close_hours, p90_close_hours from n_patterns"""))
def read_state(spark, sf):
    """The pattern table as the state holds it after a batch equals the one built from all tickets at once."""
    root, _ = base_state(spark, sf)
    I.apply_batch(spark, root, later_raw(spark, sf))
    return S.current(spark, root).patterns.drop("top1_raw")


@query("idempotent_replay", with_(SPLIT, """
select 0::bigint as ingested, (select count(*) from base) as duplicates_skipped, 0::bigint as version"""))
def idempotent_replay(spark, sf):
    root, _ = base_state(spark, sf)
    raw = tickets_raw(spark, sf).where(C.to_time(F.col("created_date")) < F.lit(CUTOFF).cast("timestamp_ntz"))
    r = I.apply_batch(spark, root, raw).summary
    return r.select("ingested", "duplicates_skipped", F.lit(S.current(spark, root).v).cast("bigint").alias("version"))


@query("state_snapshot", with_(DIFF, """
select 0::bigint as v, (select count(*) from base) as tickets, (select count(*) from o_patterns) as patterns
union all select 1, (select count(*) from clean), (select count(*) from n_patterns)"""))
def state_snapshot(spark, sf):
    """A reader that resolved version 0 keeps seeing it after version 1 is committed."""
    root, old = base_state(spark, sf)
    I.apply_batch(spark, root, later_raw(spark, sf))
    parts = [s.tickets.agg(F.lit(s.v).cast("bigint").alias("v"), F.count(F.lit(1)).alias("tickets"),
                           s.patterns.agg(F.count(F.lit(1))).scalar().alias("patterns"))
             for s in (old, S.current(spark, root))]
    return parts[0].unionByName(parts[1])


@query("incremental_stats", with_(DIFF, """
select pattern_id, total_cases, n_resolutions, top1_share, tier, median_close_hours, p90_close_hours from n_patterns"""))
def incremental_stats(spark, sf):
    base, later = split(spark, sf)
    old, new = P.joint_counts(base), P.joint_counts(later)  # each half is read once
    counts = P.sum_outcome_counts(P.outcomes_of(old), P.outcomes_of(new))
    out = I.merged_patterns(P.pattern_table(P.outcomes_of(old), P.close_of(old)), counts, P.close_of(old).unionByName(P.close_of(new)),
                            new.select("pattern_id").distinct())
    return out.select("pattern_id", "total_cases", "n_resolutions", "top1_share", "tier", "median_close_hours", "p90_close_hours")


@query("emerging_class_rate", with_(SPLIT, """
select cast(created_date as date) as day, count(*) as tickets,
 count(*) filter (pattern_id not in (select pattern_id from o_patterns)) as in_new,
 count(*) filter (pattern_id not in (select pattern_id from o_patterns)) / count(*)::double as new_share from later group by 1"""))
def emerging_class_rate(spark, sf):
    base, later = split(spark, sf)
    known = base.select("pattern_id").distinct().withColumn("known", F.lit(True))
    n = later.groupBy(F.to_date("created_date").alias("day"), "pattern_id").agg(F.count(F.lit(1)).alias("n"))
    new = F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0))
    return n.join(known, "pattern_id", "left").groupBy("day").agg(
        F.sum("n").alias("tickets"), new.alias("in_new"), (new / F.sum("n")).alias("new_share"))


@query("share_shrinkage", with_(CLEAN + """,
c as (select pattern_id, complaint_type, resolution_id, count(*) as n from clean group by 1, 2, 3),
ty as (select complaint_type, resolution_id, sum(n) / (sum(sum(n)) over (partition by complaint_type))::double as p from c group by 1, 2)""", """
select pattern_id, c.resolution_id, n as count, (n + 10.0::double * p) / ((sum(n) over (partition by pattern_id))::double + 10)
 as share from c join ty on c.complaint_type = ty.complaint_type and c.resolution_id = ty.resolution_id"""))
def share_shrinkage(spark, sf):
    return D.shrunk_shares(P.outcome_counts(clean(spark, sf)))


# --- backtest ---

BACK = SPLIT + """,
g as (select resolution_id, count(*) / (select count(*) from base)::double as p from base group by 1),
ty as (select complaint_type, resolution_id, count(*) / (sum(count(*)) over (partition by complaint_type))::double as p
 from base group by 1, 2),
bt as (select l.unique_key, l.pattern_id, o.pattern_id is not null as seen,
 l.complaint_type in (select complaint_type from base) as type_seen, g.p is not null as res_seen,
 case when o.pattern_id is not null then coalesce(oc.share, 0) end as p_pattern, coalesce(ty.p, 0) as p_type,
 coalesce(g.p, 0) as p_global, case when o.pattern_id is not null then coalesce(oc.rank = 1, false) end as top1,
 case when o.pattern_id is not null then coalesce(oc.rank <= 3, false) end as top3, coalesce(o.tier, 'new_pattern') as tier,
 coalesce(o.total_cases, 0) as train_n, o.top1_share as pred_top1_share
 from later l left join o_patterns o on l.pattern_id = o.pattern_id
 left join o_outcomes oc on l.pattern_id = oc.pattern_id and l.resolution_id = oc.resolution_id
 left join ty on l.complaint_type = ty.complaint_type and l.resolution_id = ty.resolution_id
 left join g on l.resolution_id = g.resolution_id)"""


@query("backtest_rows", with_(BACK, "select * from bt"))
def backtest_rows(spark, sf):
    base, later = split(spark, sf)
    return B.backtest_rows(base, later)


def _summary_sql(name: str, where: str, group: str | None = None) -> str:
    key = group or f"'{name}'"
    return f"""select '{name}' as part, {key} as bucket, count(*) as n, {', '.join(
        f"format('{{:.4f}}', round(avg({c}), 9))::double as {o}" for c, o in (
            ('p_pattern', 'mean_p_pattern'), ('p_type', 'mean_p_type'), ('p_global', 'mean_p_global'),
            ('top1::int', 'top1_acc'), ('top3::int', 'top3_cov'), ('pred_top1_share', 'mean_predicted_top1_share')))}
 from bt where {where} {'group by ' + group if group else ''}"""


BUCKET = "case when train_n >= 100 then 'n>=100' when train_n >= 30 then '30<=n<100' when train_n >= 5 then '5<=n<30' else 'n<5' end"


@query("backtest_summary", with_(BACK, _summary_sql("overall", "seen") + " union all " + _summary_sql("tier", "seen", "tier")
                                 + " union all " + _summary_sql("support", "seen", BUCKET)))
def backtest_summary(spark, sf):
    base, later = split(spark, sf)
    return B.backtest_summary(base, later)


@query("backtest_totals", with_(BACK, """
select (select count(*) from base) as train_tickets, count(*) as test_tickets,
 format('{:.2f}', 100 * count(*) filter (seen) / count(*)::double)::double as pattern_seen_pct,
 format('{:.2f}', 100 * count(*) filter (type_seen) / count(*)::double)::double as complaint_type_seen_pct,
 format('{:.2f}', 100 * count(*) filter (res_seen) / count(*)::double)::double as resolution_template_seen_pct,
 count(distinct pattern_id) filter (not seen) as new_patterns from bt"""))
def backtest_totals(spark, sf):
    base, later = split(spark, sf)
    return B.backtest_totals(base, later)
