"""Vectors, retrieval and its evaluation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import embed as EM
from ..functions import text as T
from ..functions.ranking import first_n
from ..operators import clean as C
from ..operators import evaluate as H
from ..operators import patterns as P
from ..operators import retrieve as R
from ..operators import vectors as X
from ..session import materialise
from ..sources import adapters as A
from .base_queries import _labels_sql, counted
from .check_sql import PATTERNS, clean_of, patterns_of, with_
from .registry import query
from .shared import stored

GATE = 0.4  # the blurred queries score lower than real complaints

# --- check SQL ---

VEC = """emb as (select vec_id, label, concat('CLASS ', label) as complaint_type, concat('Block ', vec_id // 16) as descriptor,
  cast(vec_id % 16 as int) as slot, embedding::double[] as e,
  substr(sha1(concat('CLASS ', label, chr(31), 'Block ', vec_id // 16, chr(31))), 1, 10) as pattern_id from embeddings),
vindex as (select ((('0x' || pattern_id)::bigint << 4) | slot) as vec_id, pattern_id, slot, e from emb where label <> 9),
vq as (select query_id, in_domain, gold_pattern, gold_type, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) as q
 from (select vec_id as query_id, label <> 9 as in_domain, case when label <> 9 then pattern_id end as gold_pattern,
  case when label <> 9 then complaint_type end as gold_type,
  list_transform(range(1, 65), lambda i: e[i] * 0.45::double + e[65 - i]) as q from emb) t),
vraw as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as unique_key,
  cast(o_orderdate as varchar) as created_date,
  case when vec_id // 16 % 9 = 2 then 'pending' else cast(l_shipdate as varchar) end as closed_date,
  concat('CLASS ', label) as complaint_type, descriptor,
  '' as descriptor_2, 'Closed' as status,
  case when label % 3 = 0 and l_quantity <= 48 then 'Returned in full. The unit was checked on arrival and found complete.'
   when label % 3 = 1 and l_quantity <= 28 then 'Refunded. No further action.'
   else concat('Recorded as ', l_returnflag, l_linestatus, ' in step ', l_linenumber,
    '. The case was closed after review! See note.') end as resolution_description
 from lineitem join (select vec_id, descriptor, case when label = 9 then vec_id % 9 else label end as label from emb) z
 on l_partkey % (select count(*) from emb) = vec_id join orders on l_orderkey = o_orderkey),
""" + clean_of("vraw", "vclean") + ",\n" + patterns_of("vclean", "v_") + """,
pairs as (select query_id, in_domain, gold_pattern, gold_type, i.vec_id, i.pattern_id, total_cases,
  round(list_dot_product(q, e), 9) as score from vq, vindex i left join v_patterns p on i.pattern_id = p.pattern_id),
near as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rn from pairs)"""


def ranked_sql(k: int, alpha: str = "0", floor: int = 0, name: str = "ranked", extra: str = "") -> str:
    """Pool the k * 16 nearest vectors per pattern and rank."""
    return f"""{name} as (select * from (select query_id, in_domain, gold_pattern, gold_type, pattern_id, score{extra},
 row_number() over (partition by query_id{extra} order by round(score + {alpha} * log10(1 + cases), 9) desc, pattern_id)::int as rank
 from (select query_id, any_value(in_domain) as in_domain, any_value(gold_pattern) as gold_pattern,
  any_value(gold_type) as gold_type, pattern_id, max(score) as score, any_value(total_cases) as cases from near
  where rn <= {k * 16} and total_cases is not null group by query_id, pattern_id) t{', alphas' if extra else ''}
 where cases >= {floor}) s where rank <= {k})"""


RANKED5 = VEC + ",\n" + ranked_sql(5)
ALPHA10 = VEC + ",\nalphas as (select unnest([0.0, 0.01, 0.02, 0.04])::double as alpha),\n" + ranked_sql(
    10, "alpha", extra=", alpha")

SCORED = ALPHA10 + """,
goldq as (select query_id, gold_pattern, alpha from vq, alphas where in_domain),
posn as (select g.query_id, g.alpha, g.gold_pattern, coalesce(r.rank - 1, 1000000)::bigint as pos from goldq g left join ranked r
 on g.query_id = r.query_id and g.alpha = r.alpha and g.gold_pattern = r.pattern_id),
tops as (select query_id, alpha, max(pattern_id) filter (rank = 1) as top1 from ranked group by 1, 2),
tvs as (select query_id, alpha, 0.5 * sum(abs(d)) as tv from (select query_id, alpha, resolution_id, sum(d) as d from (
  select p.query_id, p.alpha, o.resolution_id, o.share as d from posn p join v_outcomes o on o.pattern_id = p.gold_pattern
  union all select t.query_id, t.alpha, o.resolution_id, -o.share from tops t join posn using (query_id, alpha)
   join v_outcomes o on o.pattern_id = t.top1) u group by 1, 2, 3) w group by 1, 2),
covs as (select p.query_id, p.alpha, coalesce(sum(o.share) filter (exists (select 1 from ranked r join v_outcomes x
   on r.pattern_id = x.pattern_id where r.query_id = p.query_id and r.alpha = p.alpha and r.rank <= 3 and x.share >= 0.05::double
   and x.resolution_id = o.resolution_id)), 0) as coverage
 from posn p join v_outcomes o on o.pattern_id = p.gold_pattern group by 1, 2),
scored as (select p.*, t.top1, g.complaint_type as gold_kind, g.total_cases as cases, f.complaint_type as top1_type, tv, coverage
 from posn p join tops t using (query_id, alpha) join v_patterns g on g.pattern_id = p.gold_pattern
 join v_patterns f on f.pattern_id = t.top1 join tvs using (query_id, alpha) join covs using (query_id, alpha))"""

METRICS = """select alpha, count(*) as n_queries, round(avg((pos < 1)::int), 9) as recall_at_1,
 round(avg((pos < 3)::int), 9) as recall_at_3, round(avg((pos < 5)::int), 9) as recall_at_5,
 round(avg((pos < 10)::int), 9) as recall_at_10,
 round(avg(case when pos < 10 then 1.0::double / (pos + 1) else 0 end), 9) as mrr_at_10,
 round(avg((gold_kind = top1_type)::int), 9) as category_at_1,
 round(sum((pos < 1)::int * cases) / sum(cases)::double, 9) as volume_weighted_recall_at_1,
 round(avg(tv), 9) as resolution_tv_at_1, round(avg(coverage), 9) as resolution_coverage_at_3 from scored group by 1"""


# --- inputs ---


class Setup:
    """The vector side of the driver tables: index, queries and the history behind the patterns."""

    def __init__(self, spark, sf):
        self.queries = A.vector_queries(spark, sf)
        self.vectors = A.vector_index(spark, sf)
        keep = partial(stored, spark, sf)
        # three counts read them; none needs a ticket's key or dates
        t = keep("vector-tickets", lambda: C.clean_tickets(A.vector_tickets(spark, sf)).drop("unique_key", "created_date", "closed_date"))
        self.counts = keep("vector-counts", lambda: P.outcome_counts(t))
        self.patterns = keep("vector-patterns", lambda: P.pattern_table(self.counts, P.close_counts(t)))
        self.volume = self.patterns
        self.resolutions = keep("vector-resolutions", lambda: P.resolution_catalogue(t))

    def ranked(self, k=5, **kw):
        return R.rank_queries(self.queries, self.vectors, self.volume, k, **kw).drop("embedding")

    def near(self, k=10):
        return R.neighbours(self.queries, self.vectors, self.volume, k)

    def outcomes(self):
        return P.outcome_table(self.counts)


def rounded(df, places=9):
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double" and c not in ("alpha", "threshold")})


# --- vectors ---

BUCKETS = "list_transform(regexp_extract_all(lower({x}), '[a-z]+'), lambda t: (('0x' || substr(md5(t), 31, 2))::int) % 64)"


def embed_sql(x: str) -> str:
    """Hash embedding of a text in the check engine."""
    counts = f"list_transform(range(64), lambda i: len(list_filter({BUCKETS.format(x=x)}, lambda b: b = i))::double)"
    return f"""(select case when list_dot_product(c, c) = 0 then c else list_transform(c, lambda y: y / sqrt(list_dot_product(c, c))) end
 from (select {counts} as c) z)"""


@query("hash_embed", f"""
with b as (select doc_id, unnest({BUCKETS.format(x='text')}) as bucket from documents),
c as (select doc_id, bucket, count(*)::double as n from b group by 1, 2)
select doc_id, bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)), 9) as value from c""")
def hash_embed(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", EM.hash_embed(F.col("text")).alias("v"))
    return d.select("doc_id", F.posexplode("v").alias("bucket", "value")).where(F.col("value") > 0).withColumn(
        "value", F.round("value", 9))


@query("l2_normalise", """
select vec_id, pos::int - 1 as pos, round(e[pos] * 3 / sqrt(list_dot_product(list_transform(e, lambda x: x * 3), list_transform(e, lambda x: x * 3))), 9)
 as value from (select vec_id, embedding::double[] as e, unnest(range(1, 65)) as pos from embeddings) t""")
def l2_normalise(spark, sf):
    e = A.table(spark, sf, "embeddings")
    v = EM.l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3))
    return e.select("vec_id", F.posexplode(v).alias("pos", "value")).withColumn("value", F.round("value", 9))


@query("query_doc_asymmetry", """
select conv_id, turn, md5('Represent this sentence for searching relevant passages: ' || text) as with_prefix,
 md5(text) as without_prefix from conversations""")
def query_doc_asymmetry(spark, sf):
    x = F.col("text")
    return A.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(EM.query_text(x, "BAAI/bge-small-en-v1.5")).alias("with_prefix"),
        F.md5(EM.query_text(x, "BAAI/bge-m3")).alias("without_prefix"))


def text_patterns(spark, sf):
    """Every benchmark text as a pattern whose label is the text and whose examples are its sentences."""
    b = A.table(spark, sf, "benchmark").select(
        F.col("text").alias("complaint_type"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("descriptor"),
        F.lit("").alias("descriptor_2"), F.split("text", r"\. ").alias("complaints"))
    return b.withColumn("pattern_id", T.identity_hash(*[F.col(c) for c in V.LABELS]))


TEXTS = f"""tp as (select text as complaint_type, concat('item ', item_id) as descriptor, '' as descriptor_2,
 string_split(text, '. ') as complaints, substr(sha1(text || chr(31) || 'item ' || item_id || chr(31)), 1, 10) as pattern_id
 from benchmark),
rows0 as (select pattern_id, list_prepend({_labels_sql('. ', 'complaint_type descriptor descriptor_2')}, complaints)[1:16] as texts from tp),
irows as (select ((('0x' || pattern_id)::bigint << 4) | (pos - 1)) as vec_id, pattern_id, (pos - 1)::int as slot, texts[pos] as text
 from (select *, unnest(range(1, len(texts) + 1)) as pos from rows0) t)"""


@query("index_rows", with_(TEXTS, "select vec_id, pattern_id, slot, md5(text) as text_md5 from irows"))
def index_rows(spark, sf):
    p = text_patterns(spark, sf)
    return X.index_rows(p, p).select("vec_id", "pattern_id", "slot", F.md5("text").alias("text_md5"))


@query("vector_id", with_(VEC, "select vec_id, pattern_id, slot from vindex"))
def vector_id(spark, sf):
    v = A.vector_index(spark, sf)
    return v.select("vec_id", X.unpack_pattern(F.col("vec_id")).alias("pattern_id"), X.unpack_slot(F.col("vec_id")).alias("slot"))


@query("vector_id_unique", with_(VEC, """
select count(*) as vectors, count(distinct vec_id) as ids, count(*) = count(distinct vec_id) as ids_unique from vindex"""))
def vector_id_unique(spark, sf):
    return X.id_check(A.vector_index(spark, sf))


def _new_vectors(spark, sf):
    """Class 3 again with opposite sign, and the out-of-domain class for the first time."""
    e = A.indexed_embeddings(spark, sf).where(F.col("label").isin(3, A.OUT_OF_DOMAIN))
    return e.select(X.pack_vector_id(F.col("pattern_id"), F.col("slot")).alias("vec_id"), "pattern_id", "slot",
                    F.transform("embedding", lambda x: -x).alias("embedding"))


@query("upsert_vectors", with_(VEC, """
select ((('0x' || pattern_id)::bigint << 4) | slot) as vec_id, pattern_id, slot,
 round(case when label in (3, 9) then -e[1] else e[1] end, 9) as first_value from emb"""))
def upsert_vectors(spark, sf):
    out = X.upsert_vectors(A.vector_index(spark, sf), _new_vectors(spark, sf), V.EMBED_DIM)
    return out.select("vec_id", "pattern_id", "slot", F.round(F.get("embedding", F.lit(0)), 9).alias("first_value"))


@query("remove_vectors", with_(VEC, """
select ((('0x' || pattern_id)::bigint << 4) | slot) as vec_id, pattern_id, slot from emb where label not in (3, 9)"""))
def remove_vectors(spark, sf):
    return X.remove_vectors(A.vector_index(spark, sf), _new_vectors(spark, sf)).select("vec_id", "pattern_id", "slot")


@query("knn_exact", with_(VEC, "select query_id, vec_id, score, rn::int as rank from near where rn <= 5"))
def knn_exact(spark, sf):
    out = X.knn(A.vector_queries(spark, sf), A.vector_index(spark, sf), 5)
    n = out.select("query_id", F.posexplode("neighbours").alias("pos", "n"))
    return n.select("query_id", "n.vec_id", F.round("n.score", 9).alias("score"), (F.col("pos") + 1).alias("rank"))


@query("knn_blocks", with_(VEC, "select query_id, vec_id, score, rn::int as rank from near where rn <= 5"))
def knn_blocks(spark, sf):
    """The same search as ``knn_exact``, by blocks of both sides."""
    out = X.knn(A.vector_queries(spark, sf), A.vector_index(spark, sf), 5, broadcast_limit=-1, shard_rows=10_000)
    n = out.select("query_id", F.posexplode("neighbours").alias("pos", "n"))
    return n.select("query_id", "n.vec_id", F.round("n.score", 9).alias("score"), (F.col("pos") + 1).alias("rank"))


@query("max_pool_patterns", with_(VEC, """
select query_id, pattern_id, max(score) as score from near where rn <= 80 and total_cases is not null group by 1, 2"""))
def max_pool_patterns(spark, sf):
    near = Setup(spark, sf).near(5)
    return near.select("query_id", F.explode(R.max_pool(F.col("neighbours"))).alias("n")).select(
        "query_id", "n.pattern_id", "n.score")


@query("support_prior_rank", with_(VEC + ",\n" + ranked_sql(5, "0.04"), "select query_id, pattern_id, score, rank from ranked"))
def support_prior_rank(spark, sf):
    return Setup(spark, sf).ranked(alpha=0.04).select("query_id", "pattern_id", "score", "rank")


@query("min_cases_floor", with_(VEC + ",\n" + ranked_sql(5, "0.02", 60), "select query_id, pattern_id, score, rank from ranked"))
def min_cases_floor(spark, sf):
    return Setup(spark, sf).ranked(alpha=0.02, min_cases=60).select("query_id", "pattern_id", "score", "rank")


@query("search_hits", with_(RANKED5, """
select query_id, r.rank, r.pattern_id, score, complaint_type, descriptor, tier, total_cases, top1_share, median_close_hours,
 p90_close_hours, o.rank::int as outcome_rank, o.resolution_id, o.n as count, o.share, resolution_description as text
from ranked r join v_patterns p on r.pattern_id = p.pattern_id join v_outcomes o on o.pattern_id = r.pattern_id and o.rank <= 3
join v_catalogue c on c.resolution_id = o.resolution_id"""))
def search_hits(spark, sf):
    s = Setup(spark, sf)
    cards = R.pattern_cards(s.patterns, s.counts, s.resolutions, 3)
    hits = R.search_hits(s.ranked(), cards)
    o = hits.select("*", F.posexplode("resolutions").alias("pos", "o"))
    return o.select("query_id", "rank", "pattern_id", "score", "complaint_type", "descriptor", "tier", "total_cases",
                    "top1_share", "median_close_hours", "p90_close_hours", (F.col("pos") + 1).alias("outcome_rank"),
                    "o.resolution_id", "o.count", "o.share", "o.text")


DOCQ = f"""{TEXTS},
tindex as (select vec_id, pattern_id, {embed_sql('text')} as e from irows),
dq as (select doc_id, {embed_sql('text')} as q from documents),
dnear as (select doc_id, pattern_id, vec_id, round(list_dot_product(q, e), 9) as score from dq, tindex),
drn as (select *, row_number() over (partition by doc_id order by score desc, vec_id) as rn from dnear),
dpool as (select doc_id, pattern_id, max(score) as score from drn where rn <= 48 group by 1, 2)"""


@query("text_search", with_(DOCQ, """
select doc_id as query_id, pattern_id, score, rank from (select *, row_number() over (partition by doc_id
 order by score desc, pattern_id)::int as rank from dpool) t where rank <= 3"""))
def text_search(spark, sf):
    """Every document, embedded as a bag of words, against the texts and sentences of the benchmark."""
    p = text_patterns(spark, sf).withColumn("total_cases", F.lit(1).cast("bigint"))
    v = X.embed_rows(X.index_rows(p, p), EM.hash_embed)
    q = A.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), EM.hash_embed(F.col("text")).alias("embedding"))
    return R.rank_queries(q, v, p, 3).select("query_id", "pattern_id", "score", "rank")


@query("model_guard", with_(VEC, "select 'hashed-words' as index_model, true as same_model, true as other_rejected, count(*) as n from vindex"))
def model_guard(spark, sf):
    m = X.index_manifest(A.vector_index(spark, sf), Setup(spark, sf).volume, "hashed-words")
    X.guard_model(m.first().model_name, "hashed-words")
    try:
        X.guard_model(m.first().model_name, "another-model")
        rejected = False
    except ValueError:
        rejected = True
    return m.select(F.col("model_name").alias("index_model"), F.lit(True).alias("same_model"),
                    F.lit(rejected).alias("other_rejected"), "n")


@query("index_manifest", with_(VEC, """
select 'hashed-words' as model_name, 'label + synthetic example complaints' as doc_format,
 (select count(*) from v_patterns) as patterns, count(*) filter (slot > 0) as example_vectors, 64 as dim, count(*) as n from vindex"""))
def index_manifest(spark, sf):
    s = Setup(spark, sf)
    return X.index_manifest(s.vectors, s.volume, "hashed-words")


@query("index_gauges", with_(VEC, "select count(*) as vectors, (select count(*) from v_patterns) as patterns from vindex"))
def index_gauges(spark, sf):
    s = Setup(spark, sf)
    return s.vectors.agg(F.count(F.lit(1)).alias("vectors"), s.volume.agg(F.count(F.lit(1))).scalar().alias("patterns"))


SELF = PATTERNS + f""",
lab as (select pattern_id, {embed_sql('t')} as e from (select pattern_id,
 {_labels_sql('. ', 'complaint_type descriptor descriptor_2')} as t from patterns) x),
best as (select a.pattern_id, b.pattern_id as found, round(list_dot_product(a.e, b.e), 9) as score,
 row_number() over (partition by a.pattern_id order by round(list_dot_product(a.e, b.e), 9) desc, b.pattern_id) as rn from lab a, lab b)"""


@query("self_retrieval_check", with_(SELF, "select pattern_id, found, score, pattern_id = found as itself from best where rn = 1"))
def self_retrieval_check(spark, sf):
    """Each pattern's own label as a query. Labels that differ only in digits share a vector here."""
    # Written: the search measures the index, ships it and reads the queries, and each of these would count the tickets again.
    p = materialise(P.pattern_volume(counted(spark, sf)), "patterns")
    v = materialise(X.embed_rows(X.index_rows(p), EM.hash_embed), "vectors")
    q = v.select(F.col("pattern_id").alias("query_id"), "embedding")
    r = R.rank_queries(q, v, p, 1)
    return r.select(F.col("query_id").alias("pattern_id"), F.col("pattern_id").alias("found"), "score",
                    (F.col("query_id") == F.col("pattern_id")).alias("itself"))


# --- evaluation ---


@query("eval_queries", with_(TEXTS, """
select pattern_id || '-' || (pos - 1) as query_id, pattern_id as gold_pattern, md5(complaints[pos]) as complaint_md5
from (select *, unnest(range(1, len(complaints) + 1)) as pos from tp) t"""))
def eval_queries(spark, sf):
    return H.eval_queries(text_patterns(spark, sf)).select("query_id", "gold_pattern", F.md5("complaint").alias("complaint_md5"))


def scored(spark, sf, alphas=V.ALPHAS):
    s = Setup(spark, sf)
    return H.scored_queries(H.ranked_by_alpha(s.near(10), alphas=alphas), s.volume, s.outcomes())


@query("gold_position", with_(SCORED, "select query_id, gold_pattern, pos from posn where alpha = 0"))
def gold_position(spark, sf):
    r = H.ranked_by_alpha(Setup(spark, sf).near(10), alphas=[0.0]).where("in_domain")
    return r.select("query_id", "gold_pattern", H.gold_position(F.col("ranked"), F.col("gold_pattern")).alias("pos"))


def _metric(name: str, cols: str):
    select = f"select {cols} from ({METRICS}) m where alpha = 0"

    @query(name, with_(SCORED, select))
    def run(spark, sf):
        wanted = [c.strip() for c in cols.split(",")]
        return rounded(H.retrieval_metrics(scored(spark, sf, [0.0]))).select(*wanted)

    return run


_metric("recall_at_k", "n_queries, recall_at_1, recall_at_3, recall_at_5, recall_at_10")
_metric("mrr_at_10", "n_queries, mrr_at_10")
_metric("category_at_1", "n_queries, category_at_1")
_metric("volume_weighted_recall", "n_queries, volume_weighted_recall_at_1")
_metric("resolution_tv_at_1", "n_queries, resolution_tv_at_1")
_metric("resolution_coverage_at_3", "n_queries, resolution_coverage_at_3")


@query("alpha_sweep", with_(SCORED, METRICS))
def alpha_sweep(spark, sf):
    return rounded(H.retrieval_metrics(scored(spark, sf)))


@query("recall_by_support", with_(SCORED, """
select alpha, case when cases >= 100 then 'n>=100' when cases >= 30 then '30<=n<100' when cases >= 5 then '5<=n<30' else 'n<5' end
 as bucket, count(*) as n_queries, round(avg((pos < 1)::int), 9) as recall_at_1 from scored group by 1, 2"""))
def recall_by_support(spark, sf):
    return rounded(H.recall_by_support(scored(spark, sf)))


@query("no_retrieval_tv", with_(VEC + """,
prior as (select resolution_id, sum(share * total_cases) / (select sum(total_cases) from v_patterns)::double as p from v_outcomes o
 join v_patterns q on o.pattern_id = q.pattern_id group by 1),
ptv as (select q.pattern_id, 0.5 * sum(abs(coalesce(o.share, 0) - prior.p)) as tv from v_patterns q cross join prior
 left join v_outcomes o on o.pattern_id = q.pattern_id and o.resolution_id = prior.resolution_id group by 1)""", """
select count(*) as n_queries, round(avg(tv), 9) as no_retrieval_tv from vq join ptv on gold_pattern = pattern_id"""))
def no_retrieval_tv(spark, sf):
    s = Setup(spark, sf)
    return rounded(H.no_retrieval_tv(s.queries, s.volume, s.outcomes()))


TOP = VEC + ",\n" + ranked_sql(1) + ",\ntops as (select query_id, in_domain, score from ranked)"


def top_scores(spark, sf):
    return H.top_scores(Setup(spark, sf).ranked(1))


@query("abstention_auroc", with_(TOP, """
select count(*) filter (a.in_domain and b.q = a.query_id) as in_domain, (select count(*) from tops where not in_domain) as out_of_domain,
 round((select avg(case when i.score > o.score then 1.0 when i.score = o.score then 0.5 else 0 end) from tops i, tops o
  where i.in_domain and not o.in_domain), 9) as auroc from tops a, (select query_id as q from tops) b"""))
def abstention_auroc(spark, sf):
    return rounded(H.abstention_auroc(top_scores(spark, sf)))


@query("threshold_curve", with_(TOP, """
select round(0.5::double + 0.02::double * i, 2) as threshold, round(avg((score >= 0.5::double + 0.02::double * i)::int) filter (in_domain), 9) as in_domain_kept,
 round(avg((score < 0.5::double + 0.02::double * i)::int) filter (not in_domain), 9) as ood_rejected from tops, range(18) t(i) group by i"""))
def threshold_curve(spark, sf):
    return rounded(H.threshold_curve(top_scores(spark, sf)))


@query("score_percentiles", with_(TOP, """
select in_domain, round(quantile_cont(score, 0.05), 9) as p5, round(quantile_cont(score, 0.5), 9) as median, max(score) as max
from tops group by 1"""))
def score_percentiles(spark, sf):
    return rounded(H.score_percentiles(top_scores(spark, sf)))


PICKS = RANKED5 + """,
sel as (select vec_id as query_id, nullif(cast(floor(vec_id / 3) % 8 as int), 7) as selected_candidate,
 ['low', 'medium', 'high'][(vec_id % 3 + 1)::int] as confidence, cast(vec_id % 5 + 1 as int) as severity,
 case when vec_id % 2 = 0 then 'angry' else 'frustrated' end as sentiment from embeddings),
picked as (select t.query_id, t.in_domain, t.gold_pattern, t.gold_type, t.pattern_id as top1, t.score as top_score,
 p.pattern_id as pick, tp.complaint_type as top1_type, pp.complaint_type as pick_type, confidence, severity, sentiment,
 exists (select 1 from ranked g where g.query_id = t.query_id and g.pattern_id = t.gold_pattern) as in_topk
 from ranked t left join sel s on t.query_id = s.query_id
 left join ranked p on p.query_id = t.query_id and p.rank = s.selected_candidate
 left join v_patterns tp on tp.pattern_id = t.pattern_id left join v_patterns pp on pp.pattern_id = p.pattern_id
 where t.rank = 1)"""


def picked(spark, sf):
    s = Setup(spark, sf)
    return H.picked(s.ranked(), A.selections(spark, sf), s.volume)


def _share(cond: str, among: str) -> str:
    return f"round(avg(coalesce({cond}, false)::int) filter ({among}), 9)"


@query("parser_eval", with_(PICKS, f"""
select count(*) filter (in_domain) as n, count(*) filter (not in_domain) as ood_n, {_share('in_topk', 'in_domain')} as gold_in_topk,
 {_share('top1_type = gold_type', 'in_domain')} as retrieval_top1_category, {_share('top1 = gold_pattern', 'in_domain')} as retrieval_top1_pattern,
 {_share('pick_type = gold_type', 'in_domain')} as pick_category, {_share('pick = gold_pattern', 'in_domain')} as pick_pattern,
 coalesce({_share('pick = gold_pattern', 'in_domain and in_topk')}, 0) as pick_given_in_topk,
 {_share('pick is not null and top_score >= 0.4::double', 'in_domain')} as answered_both_gates, {_share('pick is null', 'in_domain')} as pick_none,
 {_share('top_score < 0.4::double', 'not in_domain')} as ood_reject_cosine, {_share('pick is null', 'not in_domain')} as ood_reject_pick,
 {_share('pick is null or top_score < 0.4::double', 'not in_domain')} as ood_reject_either from picked"""))
def parser_eval(spark, sf):
    return rounded(H.parser_eval(picked(spark, sf), GATE))


@query("selection_distributions", with_(PICKS, " union all ".join(
    f"select '{c}' as field, cast({c} as varchar) as value, count(*) as n from picked where in_domain group by 2"
    for c in ("severity", "sentiment", "confidence"))))
def selection_distributions(spark, sf):
    return H.selection_distributions(picked(spark, sf))


@query("leaked_ood", with_(PICKS, """
select query_id, pick, pick_type, top_score from picked where not in_domain and top_score >= 0.4::double and pick is not null"""))
def leaked_ood(spark, sf):
    return H.leaked_ood(picked(spark, sf), GATE)


def sample(df, n: int, key: str, seed: int):
    """A reproducible sample: the rows with the smallest salted hashes."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    return first_n(df.withColumn("__h", h), n, [F.col("__h"), F.col(key)], [F.substring("__h", 1, 4)]).drop("__h")


EVAL = TEXTS + """,
eq as (select pattern_id || '-' || (pos - 1) as query_id, pattern_id as gold_pattern, complaints[pos] as complaint
 from (select *, unnest(range(1, len(complaints) + 1)) as pos from tp) t)"""


@query("seeded_sample", with_(EVAL, "select * from eq order by md5('0:' || query_id), query_id limit 100"))
def seeded_sample(spark, sf):
    return sample(H.eval_queries(text_patterns(spark, sf)), 100, "query_id", 0)


@query("label_sheet", with_(EVAL, """
select query_id, complaint, '' as severity, '' as sentiment from eq order by md5('7:' || query_id), query_id limit 40"""))
def label_sheet(spark, sf):
    """40 sampled complaints with empty columns for labels given by hand."""
    s = sample(H.eval_queries(text_patterns(spark, sf)), 40, "query_id", 7)
    return s.select("query_id", "complaint", F.lit("").alias("severity"), F.lit("").alias("sentiment"))
