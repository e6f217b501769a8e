"""Building blocks of the check SQL (DuckDB dialect): the adapter views and the tables derived from them."""

RAW = """raw as (
 select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as unique_key,
  cast(o_orderdate as varchar) as created_date,
  case when l_discount = 0.05 and l_tax = 0.03 or p_size = 50 and p_partkey % 3 = 0 then 'pending' else cast(l_shipdate as varchar) end as closed_date,
  case when o_orderdate >= timestamp '2000-10-01' and p_size = 1 then 'NEWTYPE' else p_type end as complaint_type,
  case when p_size = 50 then concat(p_brand, ' ', p_name) else p_brand end as descriptor,
  case when o_orderpriority = '4-NOT SPECIFIED' then ' N/A ' else o_orderpriority end as descriptor_2,
  case when o_orderstatus = 'P' then 'Open' else 'Closed' end as status,
  case when l_discount = 0.1 and l_tax = 0 then 'n/a'
   when p_type = 'PROMO' and (l_linenumber <> 1 or l_quantity > 20) then 'Returned in full.'
   when p_type = 'ECONOMY' and l_linenumber > 3 then 'Refunded. No further action.'
   when o_orderdate >= timestamp '2000-10-01' and l_linenumber = 7 then 'Escalated.'
   else concat('Recorded as ', l_returnflag, l_linestatus, '.') end as resolution_description,
  case when l_linenumber = 7 then null else concat(l_returnflag, l_linestatus) end as borough,
  concat('Agency ', substr(o_orderpriority, 1, 1)) as agency
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""

EXPORT = RAW + """, export as (
 select unique_key, created_date, closed_date, agency, complaint_type, descriptor,
  case when trim(descriptor_2) = 'N/A' then null else descriptor_2 end as descriptor_2, borough, status,
  case when resolution_description = 'n/a' then null when resolution_description = 'Escalated.' then ' N/A '
   else resolution_description end as resolution_description
 from raw)"""

MISSING = "('', 'n/a', 'na', 'nan', 'none', 'null')"


def clean_of(source: str, name: str = "clean") -> str:
    return f"""{name} as (
 select *, (epoch_us(closed_date) - epoch_us(created_date)) / 3.6e9 as close_hours,
  substr(sha1(complaint_type || chr(31) || descriptor || chr(31) || descriptor_2), 1, 10) as pattern_id,
  substr(sha1(resolution_description), 1, 10) as resolution_id
 from (select unique_key, try_cast(created_date as timestamp) as created_date,
   try_cast(closed_date as timestamp) as closed_date, trim(complaint_type) as complaint_type,
   trim(descriptor) as descriptor,
   case when lower(trim(descriptor_2)) in {MISSING} then '' else trim(descriptor_2) end as descriptor_2,
   trim(resolution_description) as resolution_description
  from {source}
  where status = 'Closed' and lower(trim(resolution_description)) not in {MISSING}
   and trim(complaint_type) <> '' and trim(descriptor) <> '') t)"""


def patterns_of(clean: str, p: str = "") -> str:
    """CTEs {p}outcomes, {p}catalogue and {p}patterns over a clean-ticket relation."""
    return f"""{p}counts as (
 select pattern_id, any_value(complaint_type) as complaint_type, any_value(descriptor) as descriptor,
  any_value(descriptor_2) as descriptor_2, resolution_id, count(*) as n from {clean} group by pattern_id, resolution_id),
{p}totals as (select pattern_id, sum(n)::bigint as total_cases, count(*) as n_resolutions, max(n) as top_n,
  any_value(complaint_type) as complaint_type, any_value(descriptor) as descriptor,
  any_value(descriptor_2) as descriptor_2 from {p}counts group by pattern_id),
{p}times as (select pattern_id, quantile_cont(close_hours, 0.5) as med, quantile_cont(close_hours, 0.9) as p90
  from {clean} where close_hours is not null group by pattern_id),
{p}catalogue as (select resolution_id, resolution_description, count(*) as total_count from {clean} group by 1, 2),
{p}outcomes as (select c.pattern_id, resolution_id, n, n / total_cases::double as share_raw,
  format('{{:.4f}}', n / total_cases::double)::double as share,
  row_number() over (partition by c.pattern_id order by n desc, resolution_id) as rank
  from {p}counts c join {p}totals t on c.pattern_id = t.pattern_id),
{p}patterns as (select t.pattern_id, complaint_type, descriptor, descriptor_2, total_cases, n_resolutions,
  top_n / total_cases::double as top1_raw,
  format('{{:.4f}}', top_n / total_cases::double)::double as top1_share,
  case when top_n / total_cases::double >= 0.9 and total_cases >= 30 then 'fast_lookup'
   when top_n / total_cases::double >= 0.5 then 'rag_light' else 'rag_core' end as tier,
  format('{{:.2f}}', med)::double as median_close_hours, format('{{:.2f}}', p90)::double as p90_close_hours
  from {p}totals t left join {p}times m on t.pattern_id = m.pattern_id)"""


CLEAN = RAW + ",\n" + clean_of("raw")
PATTERNS = CLEAN + ",\n" + patterns_of("clean")
# Tickets before and from the cutoff on, with the pattern tables of the older part (o_).
SPLIT = CLEAN + """,
base as (select * from clean where created_date < timestamp '2000-07-01'),
later as (select * from clean where created_date >= timestamp '2000-07-01'),
""" + patterns_of("base", "o_")
DIFF = SPLIT + ",\n" + patterns_of("clean", "n_")


def with_(ctes: str, select: str) -> str:
    return f"with {ctes}\n{select}"
