"""Profiling queries over the ticket export."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import clean as C
from ..operators import profile as PR
from ..sources.adapters import table, tickets_export, tickets_raw
from .check_sql import EXPORT, RAW, with_
from .registry import query


def ex(spark, sf):
    return tickets_export(spark, sf)


def E(select: str) -> str:
    return with_(EXPORT, select)


COLS = ["unique_key", "created_date", "closed_date", "agency", "complaint_type", "descriptor", "descriptor_2",
        "borough", "status", "resolution_description"]
R = "format('{{:.2f}}', 100 * {a} / ({b})::double)::double"


def _pct(a, b):
    # the engine computes part / whole * 100 in this order
    return f"format('{{:.2f}}', {a} / ({b})::double * 100)::double"


@query("missing_profile", E(" union all ".join(
    f"select '{c}' as column_name, count(*) - count({c}) as missing_count, {_pct(f'(count(*) - count({c}))', 'count(*)')} "
    f"as missing_pct, count(distinct {c}) as unique_values from export" for c in COLS)))
def missing_profile(spark, sf):
    return PR.missing_profile(ex(spark, sf), unique=("unique_key",))


@query("table_summary", E(" union all ".join(
    f"select '{c}' as column_name, 'string' as type, sum(n)::bigint as filled, count(*) as distinct_values, "
    f"first(v order by n desc, v) as top_value, max(n) as top_count from (select {c} as v, count(*) as n from export "
    f"where {c} is not null group by 1) t" for c in COLS)))
def table_summary(spark, sf):
    return PR.table_summary(ex(spark, sf), unique=("unique_key",))


@query("nested_type_audit", """
select 'embedding' as column_name, 0 as dictionaries, count(*) as lists from embeddings where embedding is not null
union all select 'location', count(*), 0 from embeddings""")
def nested_type_audit(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("location", F.struct("vec_id", "label"))
    return PR.nested_type_audit(e)


@query("value_counts", E(f"""
select status as value, count(*) as n, {_pct('count(*)', '(select count(status) from export)')} as pct from export
where status is not null group by 1"""))
def value_counts(spark, sf):
    return PR.value_counts(ex(spark, sf), "status")


@query("top_resolutions", E(f"""
select resolution_description as value, count(*) as n,
 {_pct('count(*)', '(select count(resolution_description) from export)')} as pct from export
where resolution_description is not null group by 1 order by n desc, value limit 30"""))
def top_resolutions(spark, sf):
    return PR.value_counts(ex(spark, sf), "resolution_description", 30)


@query("top_descriptors", E(f"""
select descriptor as value, count(*) as n, {_pct('count(*)', '(select count(descriptor) from export)')} as pct from export
where descriptor is not null group by 1 order by n desc, value limit 30"""))
def top_descriptors(spark, sf):
    return PR.value_counts(ex(spark, sf), "descriptor", 30)


@query("crosstab_margins", E("""
select coalesce(status, 'All') as status, count(resolution_description) as available,
 count(*) - count(resolution_description) as missing, count(*) as total from export where status is not null
group by rollup(status)"""))
def crosstab_margins(spark, sf):
    return PR.crosstab_margins(ex(spark, sf))


AUDIT = ["complaint_type", "descriptor", "borough", "resolution_description"]


@query("na_audit", E(" union all ".join(
    f"select '{c}' as column_name, count(*) - count({c}) as missing, count(*) filter (upper(trim({c})) = 'N/A') as na_text, "
    f"count(distinct {c}) as unique_values from export" for c in AUDIT)))
def na_audit(spark, sf):
    return PR.na_audit(ex(spark, sf), AUDIT)


@query("distinct_per_group", E("""
select 'resolutions per type' as measure, complaint_type as key1, cast(null as varchar) as key2,
 count(distinct resolution_description) as n_distinct from export where resolution_description is not null group by 2
union all select 'resolutions per descriptor', descriptor, null, count(distinct resolution_description) from export
 where resolution_description is not null group by 2
union all select 'resolutions per pair', complaint_type, descriptor, count(distinct resolution_description) from export
 where resolution_description is not null group by 2, 3
union all select 'descriptors per type', complaint_type, null, count(distinct descriptor) from export group by 2"""))
def distinct_per_group(spark, sf):
    d = ex(spark, sf)
    r = PR.resolved(d)
    none = F.lit(None).cast("string")
    parts = [
        PR.distinct_per_group(r, ["complaint_type"], PR.RES)
        .select(F.lit("resolutions per type").alias("measure"), F.col("complaint_type").alias("key1"), none.alias("key2"), "n_distinct"),
        PR.distinct_per_group(r, ["descriptor"], PR.RES)
        .select(F.lit("resolutions per descriptor").alias("measure"), F.col("descriptor").alias("key1"), none.alias("key2"), "n_distinct"),
        PR.distinct_per_group(r, PR.PAIR, PR.RES)
        .select(F.lit("resolutions per pair").alias("measure"), F.col("complaint_type").alias("key1"),
                F.col("descriptor").alias("key2"), "n_distinct"),
        PR.distinct_per_group(d, ["complaint_type"], "descriptor")
        .select(F.lit("descriptors per type").alias("measure"), F.col("complaint_type").alias("key1"), none.alias("key2"), "n_distinct"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


COMBO = """combo as (select complaint_type, descriptor, count(unique_key) as total_cases,
 count(distinct resolution_description) as unique_resolutions from export where resolution_description is not null
 group by 1, 2)"""


@query("combo_stats", with_(EXPORT + ", " + COMBO, "select * from combo"))
def combo_stats(spark, sf):
    return PR.combo_stats(ex(spark, sf)).orderBy(F.desc("unique_resolutions"), F.desc("total_cases"), *PR.PAIR)


@query("diversity_histogram", with_(EXPORT + ", " + COMBO, f"""
select bucket, count(total_cases) as combinations, {_pct('count(total_cases)', '(select count(*) from combo)')} as pct
from (values ('1 resolution', 0, 1), ('2-3 resolutions', 1, 3), ('4-5 resolutions', 3, 5), ('6-10 resolutions', 5, 10),
 ('11+ resolutions', 10, 1000000000)) b(bucket, lo, hi) left join combo on unique_resolutions > lo and unique_resolutions <= hi
group by 1"""))
def diversity_histogram(spark, sf):
    return PR.diversity_histogram(ex(spark, sf))


@query("support_ratio", E("""
select complaint_type, descriptor, count(*) as total_resolutions, count(*) filter (n >= 5) as supported,
 count(*) filter (n >= 5) / count(*)::double as support_ratio from (select complaint_type, descriptor,
 resolution_description, count(*) as n from export where resolution_description is not null group by 1, 2, 3) t
group by 1, 2"""))
def support_ratio(spark, sf):
    return PR.support_ratio(ex(spark, sf))


USABLE = "status = 'Closed' and resolution_description is not null and upper(trim(resolution_description)) <> 'N/A'"


@query("usable_share", E(f"""
select count(*) as records, count(*) filter ({USABLE}) as usable,
 {_pct(f'count(*) filter ({USABLE})', 'count(*)')} as usable_pct from export"""))
def usable_share(spark, sf):
    return PR.usable_share(ex(spark, sf))


DUP_SETS = [["complaint_type", "descriptor", "borough", "resolution_description"],
            ["complaint_type", "descriptor", "resolution_description"]]


@query("duplicate_profile", E(" union all ".join(
    f"select '{'+'.join(s)}' as column_set, sum(n)::bigint as records, count(*) as distinct_rows, "
    f"sum(n)::bigint - count(*) as duplicate_rows from (select {', '.join(s)}, count(*) as n from export where {USABLE} "
    f"group by all) t" for s in DUP_SETS)))
def duplicate_profile(spark, sf):
    u = PR.usable_cases(ex(spark, sf))
    a, b = [PR.duplicate_profile(u, s).withColumn("column_set", F.lit("+".join(s))) for s in DUP_SETS]
    return a.unionByName(b)


TOPN = f"""ranked as (select resolution_description, n, row_number() over (order by n desc, sha1(resolution_description)) as rn
 from (select resolution_description, count(*) as n from export where {USABLE} group by 1) t)"""


@query("topn_coverage", with_(EXPORT + ", " + TOPN, f"""
select top_n, sum(n)::bigint as cases, {_pct('sum(n)', f'(select count(*) from export where {USABLE})')} as pct
from ranked, (values (5), (10), (20), (50), (100)) t(top_n) where rn <= top_n group by 1"""))
def topn_coverage(spark, sf):
    return PR.topn_coverage(PR.usable_cases(ex(spark, sf)))


@query("cumulative_coverage", with_(EXPORT + ", " + TOPN, f"""
select resolution_description, n, (sum(n) over (order by rn))::bigint as cases,
 (sum(n) over (order by rn))::bigint / (select count(*) from export where {USABLE})::double as coverage from ranked"""))
def cumulative_coverage(spark, sf):
    n = PR.usable_cases(ex(spark, sf)).groupBy(PR.RES).agg(F.count(F.lit(1)).alias("n"))
    return running_coverage(n)


def running_coverage(n):
    """Coverage after each value, most frequent first, ties by the hash of the value.

    Frequent values share log-spaced buckets; the long tail of rare ones is also split by hash prefix.
    """
    from ..functions.ranking import running_total

    n = n.withColumn("h", F.sha1(F.coalesce(PR.RES, F.lit(""))))
    rare = F.col("n") < 64
    bucket = F.struct((-F.floor(F.log2("n") * 8)).alias("a"), F.when(rare, -F.col("n")).otherwise(0).alias("b"),
                      F.when(rare, F.substring("h", 1, 3)).otherwise("").alias("c"))
    run = running_total(n, [], [F.desc("n"), F.col("h")], bucket, {"before": "n"})
    cases = (F.col("before") + F.col("n")).cast("bigint")
    return run.select(PR.RES, "n", cases.alias("cases"), (cases / n.agg(F.sum("n")).scalar()).alias("coverage"))


TS = "try_cast(created_date as timestamp)"


@query("monthly_counts", E(f"select strftime({TS}, '%Y-%m') as month, count(*) as n from export where {TS} is not null group by 1"))
def monthly_counts(spark, sf):
    return PR.counts_by_month(ex(spark, sf), C.to_time(F.col("created_date")))


@query("daily_counts", E(f"select cast({TS} as date) as day, count(*) as n from export where {TS} is not null group by 1"))
def daily_counts(spark, sf):
    return PR.counts_by_day(ex(spark, sf), C.to_time(F.col("created_date")))


RESOLVED = "from export where resolution_description is not null"


@query("descriptor2_gain", E(f"""
select records, base_unique, d2_unique, records - base_unique as base_duplicates, records - d2_unique as d2_duplicates,
 d2_unique - base_unique as additional, {_pct('(d2_unique - base_unique)', 'base_unique')} as increase_pct from (
 select (select count(*) {RESOLVED}) as records,
  (select count(*) from (select distinct complaint_type, descriptor, resolution_description {RESOLVED}) a) as base_unique,
  (select count(*) from (select distinct complaint_type, descriptor, descriptor_2, resolution_description {RESOLVED}) b)
   as d2_unique) t"""))
def descriptor2_gain(spark, sf):
    return PR.descriptor2_gain(ex(spark, sf))


@query("descriptor2_variation", E(f"""
select u as value, count(*) as n_groups from (select count(distinct descriptor_2) as u {RESOLVED}
 group by complaint_type, descriptor) t group by 1"""))
def descriptor2_variation(spark, sf):
    return PR.histogram_of(PR.descriptor2_variation(ex(spark, sf)), "unique_descriptor_2")


@query("descriptor2_multiple", E(f"""
select complaint_type, descriptor, count(distinct descriptor_2) as unique_descriptor_2 {RESOLVED} group by 1, 2
having count(distinct descriptor_2) > 1 order by 3 desc, 1, 2 limit 20"""))
def descriptor2_multiple(spark, sf):
    v = PR.descriptor2_variation(ex(spark, sf)).where(F.col("unique_descriptor_2") > 1)
    return v.orderBy(F.desc("unique_descriptor_2"), *PR.PAIR).limit(20)


@query("resolution_variation", E(f"""
select u as value, count(*) as n_groups from (select count(distinct resolution_description) as u {RESOLVED}
 and descriptor_2 is not null group by complaint_type, descriptor, descriptor_2) t group by 1"""))
def resolution_variation(spark, sf):
    return PR.histogram_of(PR.resolution_variation(ex(spark, sf)), "unique_resolutions")


@query("diversity_before_after", E(" union all ".join(
    f"select '{name}' as labels, count(*) as n_groups, count(*) filter (u > 1) as multiple, "
    f"{_pct('count(*) filter (u > 1)', 'count(*)')} as multiple_pct from (select count(distinct resolution_description) "
    f"as u {RESOLVED} {extra} group by {keys}) t" for name, keys, extra in (
        ("without_descriptor_2", "complaint_type, descriptor", ""),
        ("with_descriptor_2", "complaint_type, descriptor, descriptor_2", "and descriptor_2 is not null")))))
def diversity_before_after(spark, sf):
    return PR.diversity_before_after(ex(spark, sf))


@query("field_coverage", E(f"""
select cast(null as varchar) as complaint_type, count(*) as total_cases, count(descriptor_2) as with_value,
 count(descriptor_2) / count(*)::double * 100 as coverage_pct {RESOLVED}
union all select complaint_type, count(*), count(descriptor_2), count(descriptor_2) / count(*)::double * 100 {RESOLVED}
group by 1"""))
def field_coverage(spark, sf):
    d = ex(spark, sf)
    overall = PR.field_coverage(d, "descriptor_2").withColumn("complaint_type", F.lit(None).cast("string"))
    return overall.unionByName(PR.field_coverage(d, "descriptor_2", "complaint_type"))


KEYS4 = ["complaint_type", "descriptor", "descriptor_2", "resolution_description"]


@query("repeat_profile", E(" union all ".join(
    f"select '{name}' as representation, sum(n)::bigint as records, count(*) as representations, count(*) filter (n = 1) as once, "
    f"count(*) filter (n > 1) as repeated, coalesce(sum(n) filter (n > 1), 0)::bigint as records_in_repeated, "
    f"{_pct('coalesce(sum(n) filter (n > 1), 0)', 'sum(n)')} as repeated_pct from (select {', '.join(keys)}, count(*) as n "
    f"{RESOLVED} group by all) t" for name, keys in (("case", KEYS4), ("input", KEYS4[:3])))))
def repeat_profile(spark, sf):
    d = ex(spark, sf)
    a = PR.repeat_profile(d, KEYS4).withColumn("representation", F.lit("case"))
    return a.unionByName(PR.repeat_profile(d, KEYS4[:3]).withColumn("representation", F.lit("input")))


@query("largest_inputs", E(f"""
select complaint_type, descriptor, descriptor_2, count(*) as n {RESOLVED} group by 1, 2, 3
order by n desc, complaint_type, descriptor, descriptor_2 nulls first limit 20"""))
def largest_inputs(spark, sf):
    return PR.largest_groups(ex(spark, sf), PR.TRIPLE)


INPUTS = """inputs as (select complaint_type, descriptor, descriptor_2, sum(n)::bigint as total_cases,
 count(*) as unique_resolutions, max(n) / sum(n)::double as top1_share from (select complaint_type, descriptor, descriptor_2,
 resolution_description, count(*) as n from export where resolution_description is not null and descriptor_2 is not null
 group by 1, 2, 3, 4) t group by 1, 2, 3),
binned as (select *, case when top1_share <= 0.25 then 'very_diverse' when top1_share <= 0.5 then 'diverse'
 when top1_share <= 0.75::double then 'moderate' when top1_share <= 0.9::double then 'near_det' else 'deterministic' end as bucket
 from inputs)"""


@query("top1_share_hist", with_(EXPORT + ", " + INPUTS, """
select b.bucket, count(total_cases) as patterns, coalesce(sum(total_cases), 0)::bigint as volume,
 count(*) filter (unique_resolutions >= 2) as with_2_or_more, count(*) filter (unique_resolutions >= 3) as with_3_or_more,
 coalesce(sum(total_cases), 0) / (select sum(total_cases) from inputs)::double * 100 as volume_pct
from (values ('very_diverse'), ('diverse'), ('moderate'), ('near_det'), ('deterministic')) b(bucket)
left join binned on b.bucket = binned.bucket group by 1"""))
def top1_share_hist(spark, sf):
    return PR.top1_share_hist(ex(spark, sf))


@query("bucket_describe", with_(EXPORT + ", " + INPUTS, """
select bucket, count(*) as n, round(avg(total_cases), 6) as mean, round(stddev_samp(total_cases), 6) as std,
 min(total_cases) as min, quantile_cont(total_cases::double, 0.25) as p25, quantile_cont(total_cases::double, 0.5) as p50,
 quantile_cont(total_cases::double, 0.75) as p75, max(total_cases) as max from binned group by 1"""))
def bucket_describe(spark, sf):
    d = PR.bucket_describe(ex(spark, sf))
    return d.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def _group_pct(keys: list[str]) -> str:
    k = ", ".join(keys)
    filled = " and ".join(f"{c} is not null" for c in keys)
    return f"""select {k}, resolution_description, n, {_pct('n', f'sum(n) over (partition by {k})')} as pct
from (select {k}, resolution_description, count(*) as n {RESOLVED} and {filled} group by all) t"""


@query("group_percentages", E(_group_pct(["descriptor"])))
def group_percentages(spark, sf):
    return PR.group_percentages(ex(spark, sf), ["descriptor"])


@query("group_percentages_borough", E(_group_pct(["descriptor", "borough"])))
def group_percentages_borough(spark, sf):
    return PR.group_percentages(ex(spark, sf), ["descriptor", "borough"])


@query("group_share", E("""
select complaint_type, descriptor, n, n / (sum(n) over (partition by complaint_type))::double as share from (
 select complaint_type, descriptor, count(*) as n from export group by 1, 2) t"""))
def group_share(spark, sf):
    n = ex(spark, sf).groupBy(*PR.PAIR).agg(F.count(F.lit(1)).alias("n"))
    return PR.group_share(n, ["complaint_type"], "n")


HOURS = "(epoch_us(try_cast(closed_date as timestamp)) - epoch_us(try_cast(created_date as timestamp))) / 3.6e9"


@query("resolution_time_stats", E(f"""
select resolution_description, count(*) as n, round(avg(h), 6) as mean, quantile_cont(h, 0.5) as median, min(h) as min,
 max(h) as max from (select resolution_description, {HOURS} as h {RESOLVED}) t where h is not null group by 1"""))
def resolution_time_stats(spark, sf):
    h = C.close_hours(C.to_time(F.col("created_date")), C.to_time(F.col("closed_date")))
    return PR.resolution_time_stats(ex(spark, sf).withColumn("hours", h), "hours").withColumn("mean", F.round("mean", 6))


@query("descriptor_listing", E("""
select complaint_type, descriptor, count(*) as n, count(distinct resolution_description) as n_resolutions from export
where complaint_type is not null and descriptor is not null group by 1, 2"""))
def descriptor_listing(spark, sf):
    return PR.descriptor_listing(ex(spark, sf)).orderBy("complaint_type", F.desc("n"), "descriptor")


@query("date_range", E(f"""
select count(*) as records, min(try_cast(closed_date as timestamp)) as oldest, max(try_cast(closed_date as timestamp)) as latest,
 count(*) filter (try_cast(closed_date as timestamp) is null) as unparseable from export"""))
def date_range(spark, sf):
    return PR.date_range(ex(spark, sf), C.to_time(F.col("closed_date")))


@query("ingest_data_audit", with_(RAW, """
select count(*) as records, count(*) filter (regexp_matches(resolution_description, 'â|Ã')) as double_encoded,
 count(*) - count(distinct unique_key) as duplicate_keys from raw"""))
def ingest_data_audit(spark, sf):
    return PR.ingest_data_audit(tickets_raw(spark, sf))
