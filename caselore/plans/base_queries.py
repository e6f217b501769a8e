"""Cleaning and pattern queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import numbers as N
from ..functions import text as T
from ..operators import clean as C
from ..operators import patterns as P
from ..operators import profile as PR
from ..sources.adapters import table, tickets_export, tickets_raw
from .check_sql import CLEAN, EXPORT, PATTERNS, RAW, with_
from .registry import query
from .shared import stored


def clean(spark, sf):
    """The clean tickets as the history keeps them: a stored table."""
    return stored(spark, sf, "clean-tickets", lambda: clean_from_raw(spark, sf))


def clean_from_raw(spark, sf):
    return C.clean_tickets(tickets_raw(spark, sf))


def counted(spark, sf):
    """The clean tickets per (pattern, outcome), a stored table: of the tickets only the columns it counts are made."""
    return stored(spark, sf, "outcome-counts", lambda: P.outcome_counts(clean_from_raw(spark, sf)))


@query("pattern_table", with_(PATTERNS, """
select pattern_id, complaint_type, descriptor, descriptor_2, total_cases, n_resolutions, top1_share, tier,
 median_close_hours, p90_close_hours from patterns order by total_cases desc, pattern_id"""))
def pattern_table(spark, sf):
    return P.build_patterns(clean_from_raw(spark, sf)).drop("top1_raw").orderBy(F.desc("total_cases"), "pattern_id")


@query("fix_mojibake", """
select doc_id, (marked or strlen(text) = length(text)) as repaired,
 case when marked then length(text) else strlen(text) end as fixed_length, true as plain_same
from (select *, regexp_matches(text, '[\\x{C0}-\\x{FF}\\x{2000}-\\x{2FFF}]') as marked from documents) t""")
def fix_mojibake(spark, sf):
    d = table(spark, sf, "documents")
    twice = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    fixed = T.fix_mojibake(twice)
    return d.select("doc_id", (fixed == F.col("text")).alias("repaired"),
                    F.length(fixed).cast("bigint").alias("fixed_length"),
                    (T.fix_mojibake(F.col("text")) == F.col("text")).alias("plain_same"))


_BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)" \
          "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)" \
          "||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"


@query("strip_text", f"""
select doc_id, md5(t) as text_md5, length(t) as n from (
 select doc_id, trim(chr(160) || chr(9) || text || chr(8195) || chr(31), {_BLANKS}) as t from documents) s""")
def strip_text(spark, sf):
    padded = F.concat(F.lit(" \t"), "text", F.lit(" \x1f"))
    t = T.strip(padded)
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("n"))


@query("normalise_missing", with_(RAW, """
select case when lower(trim(descriptor_2)) in ('', 'n/a', 'na', 'nan', 'none', 'null') then '' else trim(descriptor_2) end
 as descriptor_2, count(*) as n from raw group by 1"""))
def normalise_missing(spark, sf):
    d = T.blank_missing(T.strip(F.col("descriptor_2")))
    return tickets_raw(spark, sf).groupBy(d.alias("descriptor_2")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_closed", with_(RAW, "select unique_key, status from raw where status = 'Closed'"))
def filter_closed(spark, sf):
    raw = tickets_raw(spark, sf)
    return raw.where(C.is_closed(raw)).select("unique_key", "status")


@query("filter_resolution", with_(RAW, """select unique_key, trim(resolution_description) as resolution_description
 from raw where lower(trim(resolution_description)) not in ('', 'n/a', 'na', 'nan', 'none', 'null')"""))
def filter_resolution(spark, sf):
    return C.repair_text(tickets_raw(spark, sf)).where(C.has_resolution()).select("unique_key", "resolution_description")


@query("filter_labels", with_(RAW, """select unique_key, complaint_type, descriptor from raw
 where trim(complaint_type) <> '' and trim(descriptor) <> ''"""))
def filter_labels(spark, sf):
    return C.repair_text(tickets_raw(spark, sf)).where(C.has_labels()).select("unique_key", "complaint_type", "descriptor")


@query("clean_funnel", with_(RAW, """
select count(*) as raw_rows, count(*) filter (closed) as closed, count(*) filter (closed and res) as with_resolution,
 count(*) filter (closed and res and lab) as usable from (select status = 'Closed' as closed,
  lower(trim(resolution_description)) not in ('', 'n/a', 'na', 'nan', 'none', 'null') as res,
  trim(complaint_type) <> '' and trim(descriptor) <> '' as lab from raw) t"""))
def clean_funnel(spark, sf):
    return C.clean_funnel(tickets_raw(spark, sf))


@query("parse_dates", with_(RAW, """
select unique_key, try_cast(created_date as timestamp) as created, try_cast(closed_date as timestamp) as closed,
 try_cast(closed_date as timestamp) is null as unparseable from raw"""))
def parse_dates(spark, sf):
    closed = C.to_time(F.col("closed_date"))
    return tickets_raw(spark, sf).select("unique_key", C.to_time(F.col("created_date")).alias("created"),
                                         closed.alias("closed"), closed.isNull().alias("unparseable"))


@query("close_hours", with_(RAW, """
select unique_key, (epoch_us(try_cast(closed_date as timestamp)) - epoch_us(try_cast(created_date as timestamp))) / 3.6e9
 as close_hours from raw"""))
def close_hours(spark, sf):
    hours = C.close_hours(C.to_time(F.col("created_date")), C.to_time(F.col("closed_date")))
    return tickets_raw(spark, sf).select("unique_key", hours.alias("close_hours"))


@query("identity_hash", with_(RAW, """
select distinct complaint_type, descriptor, descriptor_2,
 substr(sha1(complaint_type || chr(31) || descriptor || chr(31) || descriptor_2), 1, 10) as pattern_id,
 resolution_description, substr(sha1(resolution_description), 1, 10) as resolution_id from raw"""))
def identity_hash(spark, sf):
    labels = [F.col(c) for c in V.LABELS]
    return tickets_raw(spark, sf).select(
        *V.LABELS, T.identity_hash(*labels).alias("pattern_id"), "resolution_description",
        T.identity_hash(F.col("resolution_description")).alias("resolution_id")).distinct()


@query("clean_tickets", with_(CLEAN, """
select unique_key, created_date, closed_date, complaint_type, descriptor, descriptor_2, resolution_description,
 close_hours, pattern_id, resolution_id from clean"""))
def clean_tickets(spark, sf):
    return clean_from_raw(spark, sf)


def _tidy_sql(x: str) -> str:
    return f"""case when {x} = upper({x}) and {x} <> lower({x}) then list_aggregate(list_transform(
 regexp_extract_all({x}, '(\\p{{L}}+|\\P{{L}}+)'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), 'string_agg', '')
 else {x} end"""


@query("tidy_label", f"""
select p_partkey, {_tidy_sql('p_type')} as type_label, {_tidy_sql('n')} as name_label, {_tidy_sql('p_brand')} as brand_label
from (select *, upper(p_name) || '/' || upper(p_brand) || '''s' as n from part) t""")
def tidy_label(spark, sf):
    name = F.concat(F.upper("p_name"), F.lit("/"), F.upper("p_brand"), F.lit("'s"))
    return table(spark, sf, "part").select(
        "p_partkey", T.tidy_label(F.col("p_type")).alias("type_label"), T.tidy_label(name).alias("name_label"),
        T.tidy_label(F.col("p_brand")).alias("brand_label"))


def _labels_sql(sep: str, cols: str) -> str:
    tidy = ", ".join(_tidy_sql(c) for c in cols.split())
    return f"array_to_string(list_filter([{tidy}], lambda p: p <> ''), '{sep}')"


@query("pattern_text", with_(PATTERNS, f"""
select pattern_id, {_labels_sql('. ', 'complaint_type descriptor descriptor_2')} as pattern_text from patterns"""))
def pattern_text(spark, sf):
    p = P.pattern_volume(P.outcome_counts(clean(spark, sf)))
    return p.select("pattern_id", T.pattern_text(*[F.col(c) for c in V.LABELS]).alias("pattern_text"))


@query("candidate_label", with_(PATTERNS, f"""
select pattern_id, {_labels_sql(' / ', 'complaint_type descriptor descriptor_2')} as candidate,
 {_labels_sql(' / ', 'descriptor descriptor_2')} as product from patterns"""))
def candidate_label(spark, sf):
    p = P.pattern_volume(P.outcome_counts(clean(spark, sf)))
    return p.select("pattern_id", T.candidate_label(*[F.col(c) for c in V.LABELS]).alias("candidate"),
                    T.candidate_label(F.col("descriptor"), F.col("descriptor_2")).alias("product"))


@query("assign_tier", with_(PATTERNS, "select pattern_id, top1_raw, total_cases, tier from patterns"))
def assign_tier(spark, sf):
    return P.pattern_volume(P.outcome_counts(clean(spark, sf))).select("pattern_id", "top1_raw", "total_cases", "tier")


_WORDS = "regexp_split_to_array({x}, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+')"


def _collapse_sql(x: str) -> str:
    return f"array_to_string(list_filter({_WORDS.format(x=x)}, lambda w: w <> ''), ' ')"


@query("clean_complaint", f"""
select doc_id, md5({_collapse_sql('text')}) as complaint_md5, length({_collapse_sql('text')}) as n
from documents where length(text) between 5 and 2000""")
def clean_complaint(spark, sf):
    d = table(spark, sf, "documents").where(T.complaint_accepted(F.col("text")))
    c = T.clean_complaint(F.col("text"))
    return d.select("doc_id", F.md5(c).alias("complaint_md5"), F.length(c).cast("bigint").alias("n"))


@query("privacy_log_row", f"""
select conv_id || '-' || turn as request, substr(sha1(c), 1, 10) as text_hash, length(c)::int as text_length
from (select conv_id, turn, {_collapse_sql('text')} as c from conversations) t""")
def privacy_log_row(spark, sf):
    c = table(spark, sf, "conversations")
    row = T.log_row(F.concat_ws("-", "conv_id", "turn"), T.clean_complaint(F.col("text")))
    return c.select(row.alias("r")).select("r.*")


@query("is_truncated", f"""
select doc_id, length(t) >= 499 and not regexp_matches(t, '[.!?")]$') as truncated
from (select doc_id, rtrim(text, {_BLANKS}) as t from documents) s""")
def is_truncated(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.is_truncated(F.col("text")).alias("truncated"))


def _duration_sql(h: str) -> str:
    return f"""case when {h} is null then '{V.NO_DURATION}' when {h} >= 48 then format('{{:.1f}} hours (about {{:.0f}} days)', {h}, ({h}) / 24)
 else format('{{:.1f}} hours', {h}) end"""


@query("format_duration", f"""
select event_id, {_duration_sql('case when event_id % 10 <> 0 then value end')} as unknown, {_duration_sql('value')} as short, {_duration_sql('value * 10')} as long,
 format('{{:.4f}}', value / 7)::double as rounded from events""")
def format_duration(spark, sf):
    v = F.col("value")
    some = F.when(F.col("event_id") % 10 != 0, v)
    return table(spark, sf, "events").select("event_id", N.format_duration(some).alias("unknown"), N.format_duration(v).alias("short"),
                                             N.format_duration(v * 10).alias("long"),
                                             N.round_half_even(v / 7, 4).alias("rounded"))


@query("percent_text", with_(PATTERNS, """
select pattern_id, resolution_id, format('{:.0f}%', share * 100) as shown, share from outcomes"""))
def percent_text(spark, sf):
    o = P.outcome_table(P.outcome_counts(clean(spark, sf)))
    return o.select("pattern_id", "resolution_id", N.percent_text(F.col("share")).alias("shown"), "share")


@query("first_sentences", f"""
select doc_id, md5(array_to_string(string_split(regexp_replace(t, '([.!?])[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}]+',
 '\\1' || chr(1), 'g'), chr(1))[1:2], ' ')) as first_two
from (select doc_id, trim(text, {_BLANKS}) as t from documents) s""")
def first_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.first_sentences(F.col("text"), 2)).alias("first_two"))


def _shorten_sql(width: int, placeholder: str = " [...]") -> str:
    """For texts whose words are split by blanks alone; a word that does not fit at all leaves the placeholder."""
    flat = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    head = f"regexp_extract({flat} || ' ', '^(.{{1,{width - len(placeholder)}}}) ', 1)"
    return f"""case when length({flat}) <= {width} then {flat} when {head} = '' then '{placeholder.strip()}'
 else {head} || '{placeholder}' end"""


@query("shorten_text", f"""
select doc_id, {_shorten_sql(110)} as short, {_shorten_sql(700, ' ...')} as long from documents""")
def shorten_text(spark, sf):
    x = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.shorten(x, 110).alias("short"), T.shorten(x, 700, " ...").alias("long"))


_BARE = "regexp_replace({x}, '\\[?\\b[PR]\\d+\\b\\]?', '', 'g')"


@query("extract_numbers", f"""
select doc_id, array_to_string(regexp_extract_all({_BARE.format(x='text')}, '\\d+(?:\\.\\d+)?'), '|') as numbers
from documents""")
def extract_numbers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.numbers_in(F.col("text")), "|").alias("numbers"))


ITEM_TEXT = """text || case when conv_id % 5 = 0 then ' It closed in 9999 hours.'
 when conv_id % 5 = 1 then ' The agency WILL respond.' else '' end"""


def draft_items(spark, sf):
    """All turns as drafted items, with invented numbers and promises mixed in."""
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.expr(ITEM_TEXT).alias("item_text"),
        F.expr("case when turn % 4 = 1 then 'P1' when turn % 4 = 3 then '[P1],R1' else 'R99' end").alias("c"),
    ).select("conv_id", "turn", "item_text",
             F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.array().cast("array<string>"))
             .when((F.col("conv_id") + F.col("turn")) % 6 == 0, F.array(F.lit("R99"), F.lit("P1")))
             .otherwise(F.split("c", ",")).alias("citations"))


@query("is_prediction", f"""
select conv_id, turn, regexp_matches(t, '(?i)\\b(will|won''t|going to)\\b') as predicts
from (select conv_id, turn, {ITEM_TEXT} as t from conversations) s""")
def is_prediction(spark, sf):
    return draft_items(spark, sf).select("conv_id", "turn", T.is_prediction(F.col("item_text")).alias("predicts"))


@query("support_bucket", with_(PATTERNS, """
select case when total_cases >= 100 then 'n>=100' when total_cases >= 30 then '30<=n<100' when total_cases >= 5
 then '5<=n<30' else 'n<5' end as bucket, count(*) as patterns, sum(total_cases)::bigint as tickets from patterns group by 1"""))
def support_bucket(spark, sf):
    p = P.pattern_volume(P.outcome_counts(clean(spark, sf)))
    return p.groupBy(N.support_bucket(F.col("total_cases"), V.SUPPORT_BUCKETS).alias("bucket")).agg(
        F.count(F.lit(1)).alias("patterns"), F.sum("total_cases").alias("tickets"))


@query("tokenize", """
select doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) as n,
 md5(array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ')) as tokens_md5 from documents""")
def tokenize(spark, sf):
    t = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"),
                                                F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("cut_bins", with_(PATTERNS, """
select b.bucket, count(p.pattern_id) as patterns from (values ('very_diverse', 0, 0.25), ('diverse', 0.25, 0.5),
 ('moderate', 0.5, 0.75), ('near_det', 0.75, 0.9), ('deterministic', 0.9, 1.0)) b(bucket, lo, hi)
left join patterns p on (p.top1_raw > b.lo::double or (b.lo = 0 and p.top1_raw = 0)) and p.top1_raw <= b.hi::double group by 1"""))
def cut_bins(spark, sf):
    p = P.pattern_volume(P.outcome_counts(clean(spark, sf)))
    b = N.cut_bins(F.col("top1_raw"), PR.SHARE_EDGES, PR.SHARE_LABELS, include_lowest=True)
    return PR.with_all_labels(p.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("patterns")),
                              PR.SHARE_LABELS, ["patterns"])


@query("project_columns", with_(EXPORT, """
select unique_key, created_date, closed_date, agency, complaint_type, descriptor, borough, status, resolution_description
from export"""))
def project_columns(spark, sf):
    return tickets_export(spark, sf).select("unique_key", "created_date", "closed_date", "agency", "complaint_type",
                                            "descriptor", "borough", "status", "resolution_description")


# --- aggregations over clean tickets ---


@query("resolution_catalogue", with_(PATTERNS, "select resolution_id, resolution_description, total_count from catalogue"))
def resolution_catalogue(spark, sf):
    return P.resolution_catalogue(clean(spark, sf)).orderBy(F.desc("total_count"), "resolution_id")


@query("pattern_resolution_counts", with_(PATTERNS, """
select pattern_id, resolution_id, n as count, share, share_raw from outcomes"""))
def pattern_resolution_counts(spark, sf):
    return P.outcome_table(counted(spark, sf)).select(
        "pattern_id", "resolution_id", "count", "share", "share_raw")


@query("resolution_dist_nested", with_(PATTERNS, """
select pattern_id, rank::int as rank, resolution_id, n as count, share from outcomes"""))
def resolution_dist_nested(spark, sf):
    nested = P.nest_outcomes(P.outcome_table(counted(spark, sf)))
    return dist_explode(nested)


def dist_explode(nested):
    rows = nested.select("pattern_id", "page_no", F.posexplode("resolution_dist").alias("pos", "o"))
    return rows.select("pattern_id", (F.col("page_no") * P.PAGE + F.col("pos") + 1).alias("rank"),
                       "o.resolution_id", "o.count", "o.share")


@query("dist_explode", with_(PATTERNS, """
select pattern_id, any_value(total_cases) as total_cases, sum(share) as share_sum, count(*) as n from (
 select o.pattern_id, total_cases, share from outcomes o join totals t on o.pattern_id = t.pattern_id) s group by 1"""))
def dist_explode_query(spark, sf):
    nested = P.nest_outcomes(P.outcome_table(counted(spark, sf)))
    return dist_explode(nested).groupBy("pattern_id").agg(
        F.sum("count").alias("total_cases"), F.sum("share").alias("share_sum"), F.count(F.lit(1)).alias("n"))


@query("build_report", with_(PATTERNS, """
select count(*) as patterns, sum(total_cases)::bigint as tickets,
 count(*) filter (tier = 'fast_lookup') as patterns_fast_lookup,
 coalesce(sum(total_cases) filter (tier = 'fast_lookup'), 0)::bigint as volume_fast_lookup,
 count(*) filter (tier = 'rag_light') as patterns_rag_light,
 coalesce(sum(total_cases) filter (tier = 'rag_light'), 0)::bigint as volume_rag_light,
 count(*) filter (tier = 'rag_core') as patterns_rag_core,
 coalesce(sum(total_cases) filter (tier = 'rag_core'), 0)::bigint as volume_rag_core,
 format('{:.4f}', coalesce(sum(total_cases) filter (top1_share < 0.75), 0) / sum(total_cases)::double)::double
  as volume_share_top1_lt_075,
 count(*) filter (top1_share >= 0.9) as patterns_top1_ge_09,
 (select count(*) from catalogue) as unique_resolutions,
 (select min(created_date) from clean) as oldest, (select max(created_date) from clean) as latest from patterns"""))
def build_report(spark, sf):
    t = clean(spark, sf)
    patterns = P.pattern_volume(P.outcome_counts(t)).withColumn("top1_share", N.round_half_even(F.col("top1_raw"), 4))
    return P.build_report(patterns).withColumns({
        "unique_resolutions": P.resolution_catalogue(t).agg(F.count(F.lit(1))).scalar(),
        "oldest": t.agg(F.min("created_date")).scalar(), "latest": t.agg(F.max("created_date")).scalar()})


@query("global_dist", with_(CLEAN, """
select resolution_id, count(*) as n, count(*) / (select count(*) from clean)::double as share from clean group by 1"""))
def global_dist(spark, sf):
    return P.global_dist(clean(spark, sf))


@query("type_dist", with_(CLEAN, """
select complaint_type, resolution_id, n, n / (sum(n) over (partition by complaint_type))::double as share
from (select complaint_type, resolution_id, count(*) as n from clean group by 1, 2) t"""))
def type_dist(spark, sf):
    return P.type_dist(clean(spark, sf))


@query("rank_outcomes", with_(PATTERNS, """
select pattern_id, resolution_id, rank, rank = 1 as top1, rank <= 3 as top3 from outcomes"""))
def rank_outcomes(spark, sf):
    o = P.outcome_table(counted(spark, sf))
    return o.select("pattern_id", "resolution_id", "rank", (F.col("rank") == 1).alias("top1"),
                    (F.col("rank") <= 3).alias("top3"))


@query("n_largest", with_(PATTERNS, """
select complaint_type, descriptor, descriptor_2, total_cases, top1_share from patterns
order by total_cases desc, complaint_type, descriptor, descriptor_2 limit 20"""))
def n_largest(spark, sf):
    p = P.pattern_volume(P.outcome_counts(clean(spark, sf)))
    return p.orderBy(F.desc("total_cases"), *V.LABELS).limit(20).select(
        *V.LABELS, "total_cases", N.round_half_even(F.col("top1_raw"), 4).alias("top1_share"))


@query("multi_key_sort", with_(PATTERNS, """
select complaint_type, descriptor, descriptor_2, n_resolutions, total_cases from patterns
order by n_resolutions desc, total_cases desc, complaint_type, descriptor, descriptor_2"""))
def multi_key_sort(spark, sf):
    p = P.pattern_volume(P.outcome_counts(clean(spark, sf)))
    return p.select(*V.LABELS, "n_resolutions", "total_cases").orderBy(
        F.desc("n_resolutions"), F.desc("total_cases"), *V.LABELS)
