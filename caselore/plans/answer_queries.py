"""Answers, their checks, and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as T
from ..operators import answer as G
from ..operators import monitor as M
from ..operators import patterns as P
from ..operators import retrieve as R
from ..operators.changes import verdict_default
from ..session import fresh_path
from ..sources import adapters as A
from ..sources.tickets import write_report
from .base_queries import ITEM_TEXT, _duration_sql, _labels_sql, draft_items
from .check_sql import with_
from .registry import query
from .search_queries import GATE, PICKS, Setup
from .shared import stored

# --- check SQL ---

MAIN = PICKS + """,
m1 as (select d.doc_id as query_id, t.query_id as vec, t.* exclude (query_id), t.top_score < 0.4::double as low, s.selected_candidate,
  t.top_score >= 0.4::double and s.selected_candidate is not null as asked, true as has_draft
 from documents d join picked t on d.doc_id % (select count(*) from embeddings) = t.query_id join sel s on t.query_id = s.query_id),
m2 as (select m1.*, not low and (not asked or (pick is not null and pp.tier <> 'fast_lookup' and not has_draft)) as degraded
 from m1 left join v_patterns pp on pick = pp.pattern_id),
m3 as (select *, case when degraded then top1 when asked then pick end as main from m2),
mn as (select m3.*, p.complaint_type, p.descriptor, p.tier, p.total_cases, p.median_close_hours, p.p90_close_hours,
  case when degraded then 'template_degraded' when p.tier = 'fast_lookup' then 'template' when main is not null then 'llm' end as planned,
  case when p.tier = 'rag_core' and not degraded then 5 else 3 end as n_res from m3 left join v_patterns p on main = p.pattern_id)"""

REASON = """case when low then 'low_similarity (top cosine ' || format('{:.3f}', top_score) || ' < 0.4)'
 when asked and pick is null then 'llm_no_matching_candidate' end"""


def sources_sql(siblings: int) -> str:
    return f"""
bl as (select query_id, 1 as b, main as pattern_id, n_res as k from mn where main is not null
 union all select query_id, b + 1, pattern_id, 2 from (select mn.query_id, r.pattern_id,
  row_number() over (partition by mn.query_id order by r.rank) as b from mn join ranked r on mn.vec = r.query_id
  where main is not null and tier = 'rag_core' and not degraded and r.pattern_id <> main) z where b <= {siblings}),
sh as (select bl.query_id, b, o.rank, o.resolution_id, o.share, c.resolution_description as text from bl
 join v_outcomes o on o.pattern_id = bl.pattern_id and o.rank <= k join v_catalogue c on c.resolution_id = o.resolution_id),
firsts as (select query_id, resolution_id, min(b * 100 + rank) as pos from sh group by 1, 2),
nums as (select *, row_number() over (partition by query_id order by pos) as rn from firsts),
refs as (select sh.query_id, b, string_agg('R' || rn || ' (' || format('{{:.0f}}%', share * 100) || ')', ', ' order by rank) as refs
 from sh join nums using (query_id, resolution_id) group by 1, 2),
plines as (select bl.query_id, b, 0 as rank, '[P' || b || '] Past closed tickets of type "' || {_labels_sql(' / ', 'p.complaint_type p.descriptor')}
  || '": ' || p.total_cases || ' tickets; median time to close ' || {_duration_sql('p.median_close_hours')}
  || '; 90% of tickets closed within ' || {_duration_sql('p.p90_close_hours')} || '. Share of tickets by recorded resolution: '
  || refs || '.' as line from bl join v_patterns p on p.pattern_id = bl.pattern_id join refs using (query_id, b)),
rlines as (select sh.query_id, b, rank, '[R' || rn || '] Recorded resolution: "' || text || '"' as line from sh
 join nums using (query_id, resolution_id) where b * 100 + rank = pos),
blocks as (select query_id, string_agg(line, chr(10) order by b, rank) as block, count(*) as n_lines,
  (select count(*) from nums n where n.query_id = l.query_id) as n_resolutions
 from (select * from plines union all select * from rlines) l group by 1)"""


BARE = "regexp_replace({x}, '\\[?\\b[PR]\\d+\\b\\]?', '', 'g')"
NUMS = "regexp_extract_all({x}, '\\d+(?:\\.\\d+)?')"
SRC = MAIN + "," + sources_sql(0) + f""",
srcs as (select mn.query_id, list_prepend('P1', list_transform(range(1, n_resolutions + 1), lambda i: 'R' || i)) as ids,
 {NUMS.format(x=BARE.format(x='block'))} as numbers from mn join blocks using (query_id) where planned = 'llm')"""


def first_sql(x: str, n: int) -> str:
    return f"array_to_string(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:{n}], ' ')"


def outcomes_sql(n: int) -> str:
    """CTE lines(query_id, pos, text, cites): the outcome lines of the main pattern."""
    return f"""shown as (select sh.query_id, rank, share, text, rn from sh join nums using (query_id, resolution_id)
 where b = 1 and rank <= {n}),
rest as (select query_id, format('{{:.2f}}', 1 - list_reduce(list_prepend(0.0::double, list(share order by rank)), lambda x, y: x + y))::double as r
 from shown group by 1),
lines as (select query_id, rank as pos, format('{{:.0f}}%', share * 100) || ' of tickets: ' || {first_sql('text', 1)} as text,
  'P1,R' || rn as cites from shown
 union all select query_id, 99, format('{{:.0f}}%', r * 100) || ' of tickets: Other recorded resolutions (not listed individually).', 'P1'
 from rest where r >= 0.02::double)"""


LIST = "'[' || array_to_string(list_transform({x}, lambda u: '''' || u || ''''), ', ') || ']'"


def problem_sql(text: str, cites: str, ids: str, numbers: str) -> str:
    bare = f"list_transform({cites}, lambda c: trim(c, '[] '))"
    unknown = f"list_filter({bare}, lambda c: not list_contains({ids}, c))"
    stray = f"list_filter({NUMS.format(x=BARE.format(x=text))}, lambda n: not list_contains({numbers}, n))"
    return f"""case when trim({text}) = '' then 'empty text' when len({cites}) = 0 then 'no citation'
 when len({unknown}) > 0 then 'cites unknown source(s) ' || {LIST.format(x=unknown)}
 when len({stray}) > 0 then 'number(s) ' || {LIST.format(x=stray)} || ' not found in the sources'
 when regexp_matches({text}, '(?i)\\b(will|won''t|going to)\\b')
  then 'predicts the future (will / going to); describe what past tickets recorded instead' end"""


def opening_sql(x: str) -> str:
    return f"""case when trim({x}) = '' then 'empty opening' when regexp_matches({x}, '\\d+')
 or len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')) > 35 then 'opening must be one short sentence with no numbers' end"""


DRAFTS = SRC + f""",
body as (select doc_id as query_id, attempt, string_split(case when attempt = 1 then text else regexp_replace(text, '[0-9]', 'n', 'g') end, chr(10))
 as lines from documents, (values (1), (2)) a(attempt)),
opens as (select b.query_id, attempt, split_part(lines[1], '.', 1) as opening, {opening_sql("split_part(lines[1], '.', 1)")} as problem
 from body b join srcs using (query_id)),
items0 as (select query_id, attempt, unnest(range(1, len(lines) + 1)) as pos, unnest(lines) as text from body),
items1 as (select *, case (pos - 1) % 4 when 0 then ['P1'] when 1 then ['[P1]', 'R1'] when 2 then
 case when attempt = 1 then []::varchar[] else [' R1 '] end else ['R1', 'R99'] end as cites from items0),
items as (select i.*, {problem_sql('text', 'cites', 'ids', 'numbers')} as problem from items1 i join srcs using (query_id)),
viol as (select query_id, attempt, 0 as pos, 'opening: ' || problem as v from opens where problem is not null
 union all select query_id, attempt, pos, case when pos = 1 then 'summary' else 'steps[' || (pos - 2) || ']' end || ': ' || problem
  || ' -> "' || left(text, 80) || '"' from items where problem is not null),
nv as (select o.query_id, o.attempt, case when o.problem is null then trim(o.opening) else '' end as opening, count(v.v) as n,
 coalesce(string_agg(v.v, chr(10) order by v.pos), '') as violations, string_agg('- ' || v.v, chr(10) order by v.pos) filter (v.k <= 8) as feedback
 from opens o left join (select *, row_number() over (partition by query_id, attempt order by pos) as k from viol) v
 on v.query_id = o.query_id and v.attempt = o.attempt group by o.query_id, o.attempt, o.opening, o.problem),
parts as (select query_id, attempt, max(trim(text)) filter (pos = 1 and problem is null) as summary,
 count(*) filter (pos > 1 and problem is null) as n_steps,
 coalesce(string_agg(trim(text), '|' order by pos) filter (pos > 1 and problem is null), '') as steps from items group by 1, 2),
best as (select query_id, first_n as first_attempt_violations, case when first_n = 0 then 1 else 2 end as attempts,
 case when first_n = 0 or first_n <= second_n then 1 else 2 end as best_attempt from (select query_id,
 max(n) filter (attempt = 1) as first_n, max(n) filter (attempt = 2) as second_n from nv group by 1) t),
final as (select mn.*, b.attempts, b.first_attempt_violations, nv.n as remaining, nv.violations, nv.opening, p.summary, p.n_steps, p.steps,
 case when planned = 'llm' then case when p.summary is not null and n_steps > 0 then 'llm' else 'template' end else planned end as method
 from mn left join best b on mn.query_id = b.query_id left join nv on nv.query_id = b.query_id and nv.attempt = b.best_attempt
 left join parts p on p.query_id = b.query_id and p.attempt = b.best_attempt)"""


# --- inputs ---


def cases(spark, sf):
    """Complaints with their hits, searched once per session; without their texts, which only ``draft_prompt`` needs."""
    return stored(spark, sf, "cases", lambda: searched(spark, sf).drop("complaint"))


def searched(spark, sf):
    s = Setup(spark, sf)
    ranked = R.rank_queries(A.complaints(spark, sf).select("query_id", "embedding"), s.vectors, s.volume, 5)
    cards = R.pattern_cards(s.patterns, s.counts, s.resolutions, 5)
    return G.collect_hits(A.complaint_texts(spark, sf), ranked, cards)


def routed(spark, sf, siblings=0, found=None):
    found = cases(spark, sf) if found is None else found
    picked = G.apply_selection(G.similarity_gate(found, GATE), A.document_selections(spark, sf))
    return G.route(picked, A.drafts(spark, sf).select("query_id").distinct(), siblings)


def sourced(spark, sf, siblings=0):
    return stored(spark, sf, f"sources-{siblings}", lambda: G.with_sources(routed(spark, sf, siblings)).drop(*G.HITS))


def ready(src):
    return src.where(F.col("planned") == "llm").select("query_id", F.map_keys("sources").alias("ids"), "numbers")


def checked(spark, sf):
    return G.check_drafts(A.drafts(spark, sf), ready(sourced(spark, sf)))


def answers(spark, sf):
    # no query shows the texts of complaints beside their answers: dropped here, they are not read at all
    return G.answer_batch(searched(spark, sf).drop("complaint"), A.document_selections(spark, sf), A.drafts(spark, sf), GATE)


def kept_answers(spark, sf):
    return stored(spark, sf, "answers", lambda: answers(spark, sf))


# --- gates, routing, sources ---


@query("similarity_gate", with_(MAIN, f"""
select query_id, top_score, low as abstained, case when low then {REASON} end as reason from mn"""))
def similarity_gate(spark, sf):
    g = G.similarity_gate(cases(spark, sf), GATE)
    return g.select("query_id", "top_score", F.col("low").alias("abstained"), F.col("abstain_reason").alias("reason"))


@query("candidate_prompt", with_(MAIN, f"""
select mn.query_id, md5(string_agg(r.rank || '. ' || {_labels_sql(' / ', 'p.complaint_type p.descriptor')} || chr(10) || '   agency evidence: '
 || c.resolution_description, chr(10) order by r.rank)) as block_md5 from mn join ranked r on r.query_id = mn.vec join v_patterns p on p.pattern_id = r.pattern_id
join v_outcomes o on o.pattern_id = r.pattern_id and o.rank = 1 join v_catalogue c on c.resolution_id = o.resolution_id group by 1"""))
def candidate_prompt(spark, sf):
    return cases(spark, sf).select("query_id", F.md5(G.candidate_block(F.col("hits"))).alias("block_md5"))


@query("apply_selection", with_(MAIN, f"""
select query_id, asked, case when asked then pick end as pattern_id, {REASON} as abstain_reason,
 case when asked then severity end as severity, case when asked then sentiment end as sentiment from mn"""))
def apply_selection(spark, sf):
    a = G.apply_selection(G.similarity_gate(cases(spark, sf), GATE), A.document_selections(spark, sf))
    return a.select("query_id", "asked", "picked.pattern_id", "abstain_reason", "severity", "sentiment")


@query("route_by_tier", with_(MAIN + "," + sources_sql(2), """
select query_id, main as pattern_id, tier, planned, n_res, main is null as abstained, degraded,
 (select count(*)::int from bl where bl.query_id = mn.query_id and b > 1) as n_siblings from mn"""))
def route_by_tier(spark, sf):
    r = routed(spark, sf, siblings=2)
    return r.select("query_id", "main.pattern_id", "main.tier", "planned", "n_res", "abstained", "degraded",
                    F.size("siblings").alias("n_siblings"))


@query("build_sources", with_(MAIN + "," + sources_sql(2), """
select query_id, block as source_block, n_lines, n_resolutions from blocks"""))
def build_sources(spark, sf):
    s = sourced(spark, sf, siblings=2).where(~F.col("abstained"))
    return s.select("query_id", "source_block", F.size("source_lines").cast("bigint").alias("n_lines"),
                    F.size("rids").cast("bigint").alias("n_resolutions"))


@query("outcome_lines", with_(MAIN + "," + sources_sql(0) + "," + outcomes_sql(4), """
select query_id, string_agg(text || ' <' || cites || '>', '|' order by pos) as outcomes from lines group by 1"""))
def outcome_lines(spark, sf):
    s = sourced(spark, sf).where(~F.col("abstained"))
    o = G.outcome_lines(F.col("main"), F.col("rids"), 4)
    return s.select("query_id", F.array_join(F.transform(o, _shown), "|").alias("outcomes"))


def _shown(x):
    return F.concat(x["text"], F.lit(" <"), F.array_join(x["citations"], ","), F.lit(">"))


@query("template_answer", with_(MAIN + "," + sources_sql(0) + "," + outcomes_sql(3), f"""
select mn.query_id, format('{{:.0f}}%', share * 100) || ' of ' || total_cases || ' past tickets of this type ended with the same recorded resolution.'
 as summary, 'Tell the customer how these cases were resolved: ' || {first_sql('text', 2)} as step1,
 'Set expectations: the median time to close was ' || {_duration_sql('median_close_hours')} || ', and 90% of tickets closed within '
 || {_duration_sql('p90_close_hours')} || '.' as step2,
 (select string_agg(l.text || ' <' || cites || '>', '|' order by pos) from lines l where l.query_id = mn.query_id) as outcomes
from mn join shown s on s.query_id = mn.query_id and s.rank = 1"""))
def template_answer(spark, sf):
    s = sourced(spark, sf).where(~F.col("abstained"))
    a = s.select("query_id", G.template_answer(F.col("main"), F.col("rids")).alias("a"))
    return a.select("query_id", "a.summary.text", F.get("a.steps", F.lit(0))["text"].alias("step1"),
                    F.get("a.steps", F.lit(1))["text"].alias("step2"),
                    F.array_join(F.transform("a.outcomes", _shown), "|").alias("outcomes")).withColumnRenamed("text", "summary")


# --- checks of drafted text ---


CITES = """case when (conv_id + turn) % 7 = 0 then []::varchar[] when (conv_id + turn) % 6 = 0 then ['R99', 'P1']
 when turn % 4 = 1 then ['P1'] when turn % 4 = 3 then ['[P1]', 'R1'] else ['R99'] end"""


@query("validate_items", f"""
select conv_id, turn, {problem_sql('t', 'c', "['P1', 'R1', 'R2']", "['9', '24']")} as problem
from (select conv_id, turn, {ITEM_TEXT} as t, {CITES} as c from conversations) s""")
def validate_items(spark, sf):
    ids = F.array(*[F.lit(x) for x in ("P1", "R1", "R2")])
    numbers = F.array(F.lit("9"), F.lit("24"))
    d = draft_items(spark, sf)
    return d.select("conv_id", "turn", G.item_problem(F.col("item_text"), F.col("citations"), ids, numbers).alias("problem"))


@query("validate_opening", f"""
select doc_id, {opening_sql("split_part(text, '.', 1)")} as first_problem, {opening_sql('text')} as whole_problem from documents""")
def validate_opening(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", G.opening_problem(F.substring_index("text", ".", 1)).alias("first_problem"),
                    G.opening_problem(F.col("text")).alias("whole_problem"))


@query("clean_answer", with_(DRAFTS, """
select nv.query_id, nv.attempt, opening, summary, n_steps, md5(steps) as steps_md5, n as n_violations, md5(violations) as violations_md5
from nv join parts using (query_id, attempt)"""))
def clean_answer(spark, sf):
    c = checked(spark, sf)
    steps = F.array_join(F.transform("steps", lambda s: s["text"]), "|")
    return c.select("query_id", "attempt", "opening", F.col("summary.text").alias("summary"),
                    F.size("steps").cast("bigint").alias("n_steps"), F.md5(steps).alias("steps_md5"),
                    F.size("violations").cast("bigint").alias("n_violations"),
                    F.md5(F.array_join("violations", "\n")).alias("violations_md5"))


@query("best_attempt", with_(DRAFTS, """
select b.query_id, attempts, first_attempt_violations::int as first_attempt_violations, best_attempt, n::int as remaining
from best b join nv on nv.query_id = b.query_id and nv.attempt = b.best_attempt"""))
def best_attempt(spark, sf):
    b = G.best_attempt(checked(spark, sf))
    return b.select("query_id", "attempts", "first_attempt_violations", "best_attempt", F.size("violations").alias("remaining"))


@query("retry_feedback", with_(DRAFTS, """
select query_id, attempt, md5(chr(10) || chr(10) || 'Your previous answer broke these rules. Fix them:' || chr(10) || feedback) as feedback_md5
from nv where n > 0"""))
def retry_feedback(spark, sf):
    c = checked(spark, sf).select("query_id", "attempt", F.md5(G.retry_feedback(F.col("violations"))).alias("feedback_md5"))
    return c.where(F.col("feedback_md5").isNotNull())


@query("template_fallback", with_(DRAFTS, """
select query_id, planned, method, coalesce(attempts, 0) as attempts from final where main is not null"""))
def template_fallback(spark, sf):
    src = sourced(spark, sf)
    best = G.best_attempt(G.check_drafts(A.drafts(spark, sf), ready(src))).withColumnRenamed("violations", "remaining")
    a = G.finish_answers(src, best, GATE).where(~F.col("abstained"))
    return a.join(src.select("query_id", "planned"), "query_id").select(
        "query_id", "planned", "method", F.col("grounding.attempts").alias("attempts"))


NOTES = """array_to_string(list_filter([
 case when not degraded and top_score < 0.4::double + 0.03::double then 'Borderline match (similarity ' || format('{:.3f}', top_score)
  || ', threshold 0.4): check that the category fits before relying on this guidance.' end,
 case when not degraded and total_cases < 30 then 'Low evidence: this ticket type has only ' || total_cases
  || ' closed tickets, so the shares and times above are unreliable.' end,
 case when not degraded and severity >= 4 then 'High severity (' || severity || '/5): prioritise this ticket.' end,
 case when not degraded and severity >= 5 then 'If there is immediate danger to life or safety, tell the customer to call 911. (Standard desk policy, not drawn from historical tickets.)' end,
 case when degraded then 'Degraded mode: AI drafting is unavailable; showing historical statistics only. Category is the nearest match and was not verified.' end],
 lambda n: n is not null), '|')"""


@query("policy_notes", with_(MAIN, f"select query_id, {NOTES} as notes from mn where main is not null"))
def policy_notes(spark, sf):
    r = routed(spark, sf).where(~F.col("abstained"))
    return r.select("query_id", F.array_join(G.policy_notes(GATE), "|").alias("notes"))


@query("degraded_answer", with_(MAIN + "," + sources_sql(0) + "," + outcomes_sql(3), f"""
select mn.query_id, main as pattern_id, planned as method, {NOTES} as notes, {_labels_sql(' / ', 'complaint_type')} as category,
 format('{{:.0f}}%', share * 100) || ' of ' || total_cases || ' past tickets of this type ended with the same recorded resolution.' as summary
from mn join shown s on s.query_id = mn.query_id and s.rank = 1 where degraded"""))
def degraded_answer(spark, sf):
    """What a complaint gets when the outside pick or draft is missing."""
    a = kept_answers(spark, sf).where(F.col("method") == "template_degraded")
    return a.select("query_id", "pattern_id", "method", F.array_join("policy_notes", "|").alias("notes"), "category",
                    F.col("answer.summary.text").alias("summary"))


ANSWERED = DRAFTS + "," + outcomes_sql(3)
TEMPLATE_SUMMARY = "format('{:.0f}%', share * 100) || ' of ' || total_cases || ' past tickets of this type ended with the same recorded resolution.'"


CLAIMED = ANSWERED + f""",
claimed as (select f.query_id, 1 as id, 'summary' as kind, case when method = 'llm' then f.summary else {TEMPLATE_SUMMARY} end as claim
from final f join shown s on s.query_id = f.query_id and s.rank = 1
union all select f.query_id, 1 + row_number() over (partition by f.query_id order by i.pos)::int, 'step', trim(i.text) from final f
join best b on b.query_id = f.query_id join items i on i.query_id = f.query_id and i.attempt = b.best_attempt
where method = 'llm' and i.pos > 1 and i.problem is null
union all select f.query_id, 2, 'step', 'Tell the customer how these cases were resolved: ' || {first_sql('s.text', 2)} from final f
join shown s on s.query_id = f.query_id and s.rank = 1 where method <> 'llm'
union all select query_id, 3, 'step', 'Set expectations: the median time to close was ' || {_duration_sql('median_close_hours')}
 || ', and 90% of tickets closed within ' || {_duration_sql('p90_close_hours')} || '.' from final where method <> 'llm')"""


@query("claims", with_(CLAIMED, "select query_id, id, kind, md5(claim) as text_md5 from claimed"))
def claims(spark, sf):
    return G.claims(kept_answers(spark, sf)).select("query_id", "id", "kind", F.md5("text").alias("text_md5"))


@query("answer_batch", with_(ANSWERED, f"""
select f.query_id, main is null as abstained, case when main is null then {REASON} end as abstain_reason, top_score,
 case when main is not null then {_labels_sql('', 'complaint_type')} end as category, f.descriptor as product,
 case when asked and not degraded then severity end as severity, tier, method,
 case when main is null then null when method = 'llm' then f.summary else {TEMPLATE_SUMMARY} end as summary,
 case when main is null then '' else {NOTES} end as notes, coalesce(attempts, 0) as attempts,
 coalesce(first_attempt_violations, 0)::int as first_attempt_violations, coalesce(remaining, 0)::int as remaining
from final f left join shown s on s.query_id = f.query_id and s.rank = 1"""))
def answer_batch(spark, sf):
    a = answers(spark, sf)
    return a.select("query_id", "abstained", "abstain_reason", "top_score", "category", "product", "severity", "tier", "method",
                    F.col("answer.summary.text").alias("summary"), F.array_join("policy_notes", "|").alias("notes"),
                    F.col("grounding.attempts").alias("attempts"),
                    F.col("grounding.first_attempt_violations").alias("first_attempt_violations"),
                    F.size("grounding.remaining_violations").alias("remaining"))


@query("draft_prompt", with_(MAIN + "," + sources_sql(0), f"""
select mn.query_id, md5('Customer complaint:' || chr(10) || '\"\"\"' || chr(10) || coalesce({_labels_sql('', "''")}, '')
 || coalesce(array_to_string(list_filter(regexp_split_to_array(d.text, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+'), lambda w: w <> ''), ' '), '')
 || chr(10) || '\"\"\"' || chr(10) || chr(10) || 'Detected: ' || complaint_type || ' / ' || descriptor || '; severity ' || severity
 || '/5; sentiment ' || sentiment || '.' || chr(10) || chr(10) || 'SOURCES:' || chr(10) || block) as prompt_md5
from mn join blocks using (query_id) left join documents d on d.doc_id = mn.query_id where planned = 'llm'"""))
def draft_prompt(spark, sf):
    s = G.with_sources(routed(spark, sf, found=searched(spark, sf))).where(F.col("planned") == "llm")
    return s.select("query_id", F.md5(G.draft_prompt(F.col("complaint"), F.col("main"), F.col("severity"), F.col("sentiment"),
                                                     F.col("source_block"))).alias("prompt_md5"))


@query("judge_prompt", with_(CLAIMED, """
select c.query_id, 'SOURCES:' || chr(10) || any_value(block) || chr(10) || chr(10) || 'CLAIMS:' || chr(10)
 || string_agg(id || '. ' || claim, chr(10) order by id) as prompt from claimed c join blocks using (query_id) group by 1"""))
def judge_prompt(spark, sf):
    a = kept_answers(spark, sf).where(~F.col("abstained"))
    texts = F.concat(F.array("answer.summary.text"), F.transform("answer.steps", lambda s: s["text"]))
    return a.select("query_id", G.judge_prompt(F.col("source_block"), texts).alias("prompt"))


@query("example_prompt", """
select p_partkey, 'Problem category (hidden from the resident): ' || p_name || chr(10) || 'Write 4 different complaints.' as prompt from part""")
def example_prompt(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", G.example_prompt(F.col("p_name")).alias("prompt"))


# --- reports over answers ---

VERDICTS = """jv as (select c.query_id, c.id, coalesce(v.verdict, 'unsupported') as verdict from cl c left join (
 select conv_id as query_id, cast(floor((turn + 1) / 2) as int) as id, case when length(text) % 3 = 0 then 'partial' else 'supported' end as verdict
 from conversations where role = 'assistant') v on v.query_id = c.query_id and v.id = c.id)"""
CLAIM_IDS = """cl as (select query_id, unnest(range(1, 2 + (case when method = 'llm' then n_steps else 2 end)::int))::int as id
 from final where main is not null)"""
JUDGED = DRAFTS + ",\n" + CLAIM_IDS + ",\n" + VERDICTS


def _pct1(a: str, b: str) -> str:
    return f"case when {b} > 0 then format('{{:.1f}}', 100 * ({a}) / ({b})::double)::double end"


REPORT_STAGES = {"retrieve": "total_ms / 4", "parse": "case when query_id % 5 <> 0 then total_ms / 8 end",
                 "generate": "case when query_id % 5 <> 1 then total_ms / 2 end"}


def _listing_sql(rows: str, key: str = "k", shown: str = "k || ' ' || n") -> str:
    return f"(select coalesce(string_agg({shown}, '|' order by {key}), '') from ({rows}) t)"


@query("generation_report", with_(JUDGED + """,
pv as (select query_id, count(*) as items, count(*) filter (verdict = 'supported') as ok, count(*) filter (verdict = 'partial') as partial
 from jv group by 1),
fx as (select f.*, items, ok, partial, main is not null as answered, main is not null and (method = 'llm' or coalesce(attempts, 0) > 0) as drafted,
 lower(complaint_type) = lower(gold_type) as good from final f left join pv on pv.query_id = f.query_id),
fi as (select * from fx where in_domain),
lat as (select query_id, ((doc_id * 37) % 5000 + 500)::double as total_ms from fi join documents on doc_id = query_id where answered)""", f"""
select count(*) as n, {_pct1('count(*) filter (answered)', 'count(*)')} as answered_pct,
 {_pct1('count(*) filter (answered and good)', 'count(*)')} as end_to_end_category_acc_pct,
 {_pct1('count(*) filter (answered and good)', 'count(*) filter (answered)')} as category_acc_when_answered_pct,
 {_pct1('count(*) filter (drafted and first_attempt_violations > 0)', 'count(*) filter (drafted)')} as first_attempt_violation_pct,
 {_pct1('count(*) filter (drafted and remaining > 0)', 'count(*) filter (drafted)')} as remaining_violation_pct,
 count(*) filter (answered and method = 'template' and tier <> 'fast_lookup') as template_fallbacks,
 {_pct1('sum(ok)', 'sum(items)')} as supported_pct, {_pct1('sum(partial)', 'sum(items)')} as partial_pct,
 {_pct1('sum(items - ok - partial)', 'sum(items)')} as unsupported_pct,
 {_pct1('count(*) filter (items = ok)', 'count(*) filter (answered)')} as fully_supported_pct,
 {_listing_sql(f"select split_part({REASON}, ' ', 1) as k, count(*) as n from fi where not answered group by 1")} as abstain_reasons,
 {_listing_sql("select tier as k, count(*) as n from fi where answered group by 1")} as tier_mix,
 {_listing_sql("select method as k, count(*) as n, coalesce(sum(items), 0)::bigint as its, coalesce(sum(ok), 0)::bigint as oks from fi where answered group by 1",
               shown="k || ' ' || n || ' ' || its || case when its > 0 then ' ' || format('{:.1f}', 100 * oks / its::double) else '' end")} as by_method,
 (select floor(quantile_cont(total_ms, 0.5))::bigint from lat) as latency_p50_ms,
 (select floor(quantile_cont(total_ms, 0.95))::bigint from lat) as latency_p95_ms,
 {', '.join(f"(select floor(round(avg(coalesce({x}, 0)), 6))::bigint from lat) as mean_{stage}_ms" for stage, x in REPORT_STAGES.items())},
 (select count(*) from fx where not in_domain) as ood_n,
 (select {_pct1('count(*) filter (not answered)', 'count(*)')} from fx where not in_domain) as ood_abstained_pct,
 {_listing_sql(f"select split_part(coalesce({REASON}, 'answered'), ' ', 1) as k, count(*) as n from fx where not in_domain group by 1")} as ood_reasons,
 {_listing_sql(f"select query_id as k, {_labels_sql('', 'complaint_type')} || ' / ' || descriptor || ' <- ' || query_id as n from fx"
               " where not in_domain and answered order by query_id limit 8", shown="n")} as ood_passed_through from fi"""))
def generation_report(spark, sf):
    a = kept_answers(spark, sf)
    v = verdict_default(G.claims(a), A.verdicts(spark, sf), ["query_id", "id"])
    return M.generation_report(a, v, A.timings(spark, sf))


@query("generation_breakdowns", with_(JUDGED, f"""
select 'abstain_reason' as section, split_part({REASON}, ' ', 1) as key, count(*) as n from final where in_domain and main is null group by 2
union all select 'tier', tier, count(*) from final where in_domain and main is not null group by 2
union all select 'method', method, count(*) from final where in_domain and main is not null group by 2
union all select 'supported_items', method, count(*) filter (verdict = 'supported') from jv join final using (query_id) where in_domain group by 2"""))
def generation_breakdowns(spark, sf):
    a = kept_answers(spark, sf)
    v = verdict_default(G.claims(a), A.verdicts(spark, sf), ["query_id", "id"])
    return M.report_breakdowns(a, v)


@query("method_report", with_(JUDGED + """,
pv as (select query_id, count(*) as items, count(*) filter (verdict = 'supported') as ok from jv group by 1)""", f"""
select method, count(*) as answers, coalesce(sum(items), 0)::bigint as items, coalesce(sum(ok), 0)::bigint as supported,
 {_pct1('coalesce(sum(ok), 0)', 'coalesce(sum(items), 0)')} as supported_pct
from final f left join pv on pv.query_id = f.query_id where in_domain and main is not null group by method"""))
def method_report(spark, sf):
    a = kept_answers(spark, sf)
    return M.method_report(a, verdict_default(G.claims(a), A.verdicts(spark, sf), ["query_id", "id"]))


@query("outside_report", with_(DRAFTS, f"""
select set_name, count(*) as n, {_pct1('count(*) filter (main is null)', 'count(*)')} as abstained_pct,
 count(*) filter (main is null and low) as low_similarity, count(*) filter (main is null and not low) as llm_no_matching_candidate,
 coalesce(array_to_string(list_slice(list(query_id order by query_id) filter (main is not null), 1, 5), '|'), '') as let_through
from (select *, case when query_id % 2 = 0 then 'even' else 'odd' end as set_name from final where not in_domain) t group by set_name"""))
def outside_report(spark, sf):
    """Two sets of complaints outside the domain."""
    return M.outside_report(kept_answers(spark, sf), F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))


@query("answer_samples", with_(ANSWERED, f"""
select f.query_id, main is null as abstained, tier, method,
 case when main is null then null when method = 'llm' then f.summary else {TEMPLATE_SUMMARY} end as summary, coalesce(attempts, 0)::bigint as attempts
from final f left join shown s on s.query_id = f.query_id and s.rank = 1"""))
def answer_samples(spark, sf):
    """One JSON line per answer, for reading by hand, written and read back."""
    path = fresh_path(spark, "samples")
    a = kept_answers(spark, sf)
    write_report(a.select("query_id", "abstained", "tier", "method", F.col("answer.summary.text").alias("summary"),
                          F.col("grounding.attempts").alias("attempts")), path)
    return spark.read.schema("query_id long, abstained boolean, tier string, method string, summary string, attempts long").json(path)


# --- monitoring ---

LOG = """log as (select event_id, ts, event_type = 'error' as abstained,
 case when event_type = 'error' then 'low_similarity (top cosine)' else 'none' end as reason,
 case when event_type = 'purchase' then 'fast_lookup' when event_type = 'click' then 'rag_light' else 'rag_core' end as tier,
 case when event_type = 'signup' then 'template_degraded' when event_type = 'purchase' then 'template' else 'llm' end as method,
 cast(1 + event_id % 5 as int) as severity, cast((event_id * 37) % 500 as double) / 1000 + 0.5::double as top_score,
 value * 100 as total_ms, cast(event_id % 3 as int) as first_attempt_violations, length(props) + event_id % 50 as prompt_tokens,
 event_id % 20 as completion_tokens from events)"""



@query("ask_metrics", with_(LOG, """
select 'requests' as metric, case when abstained then 'abstained' else 'answered' end as label1,
 case when abstained then split_part(reason, ' ', 1) else 'none' end as label2, count(*) as n from log group by 2, 3
union all select 'tier', tier, '', count(*) from log where not abstained group by 2
union all select 'method', method, '', count(*) from log where not abstained group by 2
union all select 'severity', severity::varchar, '', count(*) from log where not abstained group by 2
union all select 'tokens', 'prompt_tokens', '', sum(prompt_tokens)::bigint from log
union all select 'tokens', 'completion_tokens', '', sum(completion_tokens)::bigint from log
union all select 'first_attempt_violations', '', '', count(*) from log where not abstained and first_attempt_violations > 0"""))
def ask_metrics(spark, sf):
    return M.ask_metrics(A.answer_log(spark, sf))


def _hist_sql(metric: str, x: str, buckets: list) -> str:
    bounds = " union all ".join(f"select '{b}' as le, {b}::double as bound" for b in buckets)
    return f"""select '{metric}' as metric, le, count(*) filter ({x} <= bound) as bucket_count, count(*) as count, round(sum({x}), 6) as sum
 from log, ({bounds} union all select '+Inf', 1e308::double) b group by le"""


@query("histogram_le", with_(LOG, _hist_sql("latency_total", "total_ms / 1000", V.LATENCY_BUCKETS) + " union all "
                             + _hist_sql("top_cosine", "top_score", V.COSINE_BUCKETS)))
def histogram_le(spark, sf):
    log = A.answer_log(spark, sf)
    a = M.histogram_le(log, F.col("total_ms") / 1000, V.LATENCY_BUCKETS).withColumn("metric", F.lit("latency_total"))
    b = M.histogram_le(log, F.col("top_score"), V.COSINE_BUCKETS).withColumn("metric", F.lit("top_cosine"))
    return a.unionByName(b).withColumn("sum", F.round("sum", 6))


STAGES = LOG + """,
staged as (select 'total' as stage, method, abstained, total_ms as ms from log union all select 'retrieve', method, abstained, total_ms / 4 from log
 union all select 'parse', method, abstained, total_ms * 0.15::double from log where method <> 'template'
 union all select 'generate', method, abstained, total_ms * 0.6::double from log where not abstained)"""


@query("stage_histogram", with_(STAGES, f"""select stage, le, count(*) filter (ms / 1000 <= bound) as bucket_count, count(*) as count,
 round(sum(ms / 1000), 6) as sum from staged, ({" union all ".join(f"select '{b}' as le, {b}::double as bound" for b in V.LATENCY_BUCKETS)}
 union all select '+Inf', 1e308::double) b group by stage, le"""))
def stage_histogram(spark, sf):
    return M.stage_histogram(A.answer_log(spark, sf)).withColumn("sum", F.round("sum", 6))


@query("stage_means", with_(STAGES, """
select method, stage, count(*) as n, round(avg(ms), 6) as mean_ms from staged where not abstained group by method, stage"""))
def stage_means(spark, sf):
    return M.stage_means(A.answer_log(spark, sf))


@query("latency_report", with_(LOG, """
select method, floor(quantile_cont(total_ms, 0.5))::bigint as p50_ms, floor(quantile_cont(total_ms, 0.95))::bigint as p95_ms,
 floor(round(avg(total_ms), 6))::bigint as mean_ms from log where not abstained group by 1"""))
def latency_report(spark, sf):
    return M.latency_report(A.answer_log(spark, sf))


def _quantile_sql(q: float, x: str, buckets: list) -> str:
    out, prev, below = "case", "0", "0"
    for b in buckets:
        at = f"count(*) filter ({x} <= {b}::double)"
        out += f" when {at} >= count(*) * {q}::double then coalesce({prev}::double + ({b}::double - {prev}::double) * (count(*) * {q}::double - {below}) / nullif({at} - {below}, 0), {b}::double)"
        prev, below = str(b), at
    return out + f" else {buckets[-1]}::double end"


def windows_sql(minutes: int) -> str:
    return f"""(select ws as window_start, ws + interval {minutes} minute as window_end, count(*) as requests,
 count(*) filter (abstained) / count(*)::double as abstain_rate, {_quantile_sql(0.5, 'top_score', V.COSINE_BUCKETS)} as median_top_score,
 count(*) filter (not abstained and method = 'template_degraded') as degraded,
 count(*) filter (not abstained and first_attempt_violations > 0) / nullif(count(*) filter (not abstained), 0)::double as retry_rate,
 {_quantile_sql(0.95, 'total_ms / 1000', V.LATENCY_BUCKETS)} as p95_latency, count(*) filter (reason = 'internal error') as errors
 from (select *, time_bucket(interval 5 minute, ts) - to_minutes(5 * i) as ws from log, range({minutes // 5}) r(i)) t group by 1)"""


@query("alert_windows", with_(LOG, f"""
select window_start, window_end, requests, round(abstain_rate, 9) as abstain_rate, round(median_top_score, 9) as median_top_score, degraded,
 round(retry_rate, 9) as retry_rate, round(p95_latency, 9) as p95_latency, errors from {windows_sql(60)} w"""))
def alert_windows(spark, sf):
    w = M.alert_windows(A.answer_log(spark, sf), "1 hour")
    return w.withColumns({c: F.round(c, 9) for c in ("abstain_rate", "median_top_score", "retry_rate", "p95_latency")})


BROKEN = f"""select window_start, window_end, 'errors_present' as alert from {windows_sql(5)} a where errors > 0
union all select window_start, window_end, 'degraded_mode' from {windows_sql(10)} b where degraded > 0
union all select window_start, window_end, 'slow_answers' from {windows_sql(10)} c where p95_latency > 10
union all select window_start, window_end, 'high_abstain_rate' from {windows_sql(30)} d where abstain_rate > 0.25::double
union all select window_start, window_end, 'retries_rising' from {windows_sql(60)} e where retry_rate > 0.25::double
union all select window_start, window_end, 'top_similarity_drift' from {windows_sql(60)} f where median_top_score < 0.72::double"""


@query("window_alerts", with_(LOG, BROKEN))
def window_alerts(spark, sf):
    return M.window_alerts(A.answer_log(spark, sf))


@query("alert_states", with_(LOG + f""",
broken as ({BROKEN}),
marked as (select alert, window_end, case when lag(window_end) over (partition by alert order by window_end) = window_end - interval 5 minute
 then 0 else 1 end as starts from broken),
runs as (select *, sum(starts) over (partition by alert order by window_end) as run from marked),
sinces as (select alert, window_end, min(window_end) over (partition by alert, run) as since from runs)""", f"""
select alert, window_end, since, case when date_diff('minute', since, window_end) >= case alert
 {' '.join(f"when '{n}' then {r[4]}" for n, r in V.ALERT_RULES.items())} end then 'firing' else 'pending' end as state from sinces"""))
def alert_states(spark, sf):
    return M.alert_states(A.answer_log(spark, sf))
