"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (decontaminate, html_text, infill, mtree, neardup, negatives, packing, preference, quality, shards, simhash, token_counts,
               toxicity)
from .common import table
from .registry import CHECKS, QUERIES, query  # noqa: F401
from .token_counts import vocabulary_path


TOXIC_FROM = 0.5
QUALITY_FROM = 0.5
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def held_out(id_column: str = "doc_id"):
    """True for the third of ids whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_chain(spark, sf):
    """Low quality first, then toxic: the given labels name these two."""
    return toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"), CATEGORIES)


def quality_model(spark, sf):
    return quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels").where(~held_out()))


@query("op1_toxicity")
def op1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_chain(spark, sf)).select(
        "doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= TOXIC_FROM).cast("int").alias("toxic"))


@query("op2_html_text")
def op2(spark, sf):
    return html_text.extract(table(spark, sf, "pages"))


@query("op3_decontamination")
def op3(spark, sf):
    return decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_sharding")
def op4(spark, sf):
    return shards.shard(table(spark, sf, "documents"), shards=24).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query("op5_packing")
def op5(spark, sf):
    return packing.pack(table(spark, sf, "documents"), vocabulary_path(), keep_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


_SEGMENTS = """
    with last as (
      select conv_id, max(turn) as t from conversations where role = 'assistant' group by conv_id),
    reply as (
      select c.conv_id, c.turn, c.text from conversations c join last l on c.conv_id = l.conv_id and c.turn = l.t),
    rejected as (
      select c.conv_id, c.turn, c.role, case when r.turn = c.turn then o.text else c.text end as text
      from conversations c left join reply r on r.conv_id = c.conv_id
      left join reply o on o.conv_id = xor(c.conv_id, 1)),
    rejected_turns as (select * from rejected where text is not null),
    ends as (
      select coalesce(c.conv_id, r.conv_id) as pair_id, min(coalesce(c.turn, r.turn)) as first_other
      from conversations c full join rejected_turns r on c.conv_id = r.conv_id and c.turn = r.turn
      where c.text is distinct from r.text or c.role is distinct from r.role group by 1),
    parts as (
      select conv_id as pair_id, 'chosen' as side, turn, role, text from conversations
      union all select conv_id, 'rejected', turn, role, text from rejected_turns),
    segments as (
  select p.pair_id, case when first_other is null or turn < first_other then 'prompt' else side end as part, turn, role,
             '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as rendered,
             coalesce(turn >= first_other, false) and role = 'assistant' as loss
      from parts p left join ends e on e.pair_id = p.pair_id
      where side = 'chosen' or turn >= first_other)"""


@query("preference_segments", _SEGMENTS + " select * from segments")
def preference_segments(spark, sf):
    """A row for each rendered turn."""
    return preference.segments(*preference.swapped_replies(table(spark, sf, "conversations")))


@query("op6_preference", _SEGMENTS + """,
    placed as (
      select *, length(rendered) as chars, coalesce(sum(length(rendered)) over (
        partition by pair_id, part order by turn, role, rendered rows between unbounded preceding and 1 preceding), 0)::bigint as begins
      from segments),
    pieces as (select *, begins // 1048576 as piece from placed),
    counted as (select pair_id, count(distinct piece) as n_pieces from pieces group by pair_id)
    select p.pair_id, piece, any_value(n_pieces) as n_pieces,
           coalesce(string_agg(rendered, '' order by begins) filter (part = 'prompt'), '') as prompt,
           coalesce(string_agg(rendered, '' order by begins) filter (part = 'chosen'), '') as chosen,
           coalesce(string_agg(rendered, '' order by begins) filter (part = 'rejected'), '') as rejected,
           coalesce(string_agg(begins || '-' || (begins + chars), ',' order by begins) filter (part = 'chosen' and loss), '') as chosen_loss,
           coalesce(string_agg(begins || '-' || (begins + chars), ',' order by begins) filter (part = 'rejected' and loss), '') as rejected_loss
    from pieces p join counted e on e.pair_id = p.pair_id group by p.pair_id, piece""")
def op6(spark, sf):
    """Paired masked completions; the spans to be trained on as from-to, in characters."""
    def spans(name):
        return F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["from"], s["to"])), ",").alias(name)

    rows = preference.pairs(preference.segments(*preference.swapped_replies(table(spark, sf, "conversations"))))
    return rows.select("pair_id", "piece", "n_pieces", "prompt", "chosen", "rejected", spans("chosen_loss"), spans("rejected_loss"))


@query("op7_near_duplicates", """
    with recursive w as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (
      select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
             else list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) end) as shingle from w),
    n as (select doc_id, count(*) as n from s group by doc_id),
    links as (
      select a.doc_id as a, b.doc_id as b from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id
      join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
      group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
    reach as (
      select doc_id as a, doc_id as b from w union select r.a, l.b from reach r join links l on l.a = r.b)
    select w.doc_id, coalesce(n.n, 0) as n_shingles, c.least as component_id, c.least = w.doc_id as kept
    from w left join n on n.doc_id = w.doc_id join (select a, min(b) as least from reach group by a) c on c.a = w.doc_id""")
def op7(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents")).drop("text_hash")


@query("op8_quality")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.score(docs, quality_model(spark, sf)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


@query("op9_mtree_top5", """
    with v as (
      select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
      select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score
      from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
    ranked as (
      select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
      from scored)
    select * from ranked where rank <= 5""")
def op9(spark, sf):
    return mtree.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op10_token_counts")
def op10(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"), vocabulary_path())


@query("op11_simhash")  # no SQL: XXH64 is not among its functions
def op11(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op12_hard_negatives", """
    with v as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
      where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
      select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, list_dot_product(a.e, v.e)::bigint as score
      from v a join v on a.vec_id <> v.vec_id where a.vec_id % 50 = 0),
    positives as (
      select anchor_id, vec_id as positive_id, score as positive_score from scored where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank,
           vec_id as negative_id, positive_score, score as negative_score
    from positives p join scored s on s.anchor_id = p.anchor_id
    where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
    qualify rank <= 3""")
def op12(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, label)


@query("op13_fill_in_middle", """
    with d as (
      select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
    u as (
      select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units,
             ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2,
             ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4 from d),
    c as (
      select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::bigint as a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::bigint as b,
             case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
                  when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
    p as (
      select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle,
             array_to_string(units[b + 1:n], '') as suffix from c)
    select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
           case when form <> 'plain' then length(middle) end as middle_chars,
           sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
           sha256(text) as restored_sha256 from p""")
def op13(spark, sf):
    return infill.digests(infill.transform(table(spark, sf, "documents")))
