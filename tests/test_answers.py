from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caselore import fixed_values as V
from caselore.functions import text as T
from caselore.operators import answer as G
from caselore.operators import monitor as M
from caselore.operators import retrieve as R
from caselore.streaming.jobs import stream_alert_windows, triage
from conftest import OPEN, SIZE, complaints, hours_of

TEXTS = ["library card refused at the gate", "ferry crossing missed", "parcel arrived wet", "zebra quartz violin"]
SEL = "query_id long, selected_candidate int, confidence string, severity int, sentiment string"
DRAFT = ("query_id long, attempt int, opening string, summary struct<text:string,citations:array<string>>, "
         "steps array<struct<text:string,citations:array<string>>>")
GOOD = ("I am sorry about this.", ("Past tickets ended in different ways.", ["P1"]), [("Tell them what was recorded.", ["R1"])])


@pytest.fixture(scope="module")
def cases(spark, history):
    q = complaints(spark, TEXTS)
    ranked = R.rank_queries(q.select("query_id", "embedding"), history.vectors, history.patterns, 5)
    return G.collect_hits(q.drop("embedding"), ranked, history.cards).persist()


def picks(spark, rows):
    return spark.createDataFrame([(q, n, "high", s, "angry") for q, n, s in rows], SEL)


def drafts(spark, *rows):
    return spark.createDataFrame([(q, a, *d) for q, a, d in rows], DRAFT)


def answer(spark, cases, sel, dr, **kw):
    return {r.query_id: r for r in G.answer_batch(cases, sel, dr, **kw).collect()}


def test_routes(spark, cases):
    got = answer(spark, cases, picks(spark, [(0, 1, 3), (1, 1, 5), (2, 1, 4), (3, 1, 1)]), drafts(spark, (0, 1, GOOD), (1, 1, GOOD)))
    assert [got[i].method for i in range(4)] == ["llm", "llm", "template", None]
    assert [got[i].tier for i in range(3)] == ["rag_core", "rag_light", "fast_lookup"]
    assert got[3].abstained and got[3].abstain_reason.startswith("low_similarity (top cosine 0.") and got[3].severity is None
    assert got[0].answer.summary.text == GOOD[1][0] and len(got[0].answer.outcomes) == 4
    assert got[1].policy_notes == ["High severity (5/5): prioritise this ticket.", V.EMERGENCY_NOTE]
    assert got[2].answer.summary.text == "94% of 36 past tickets of this type ended with the same recorded resolution."
    assert got[0].category == OPEN and got[0].product == "Refused at the gate"


def test_no_candidate_and_missing_steps(spark, cases):
    got = answer(spark, cases, picks(spark, [(0, 0, 2), (1, 9, 2), (2, None, 2)]), drafts(spark))
    assert got[0].abstain_reason == got[1].abstain_reason == "llm_no_matching_candidate" and got[0].severity == 2
    assert got[2].method == "template_degraded" and got[2].policy_notes == [V.DEGRADED_NOTE] and got[2].severity is None
    late = answer(spark, cases, picks(spark, [(0, 1, 2)]), drafts(spark))
    assert late[0].method == "template_degraded"


def test_borderline_and_little_evidence(spark, cases, history):
    g = G.similarity_gate(cases, 0.99)
    main = F.get("hits", F.lit(0)).withField("total_cases", F.lit(12).cast("long"))
    notes = g.where("query_id = 0").select(F.lit(False).alias("degraded"), F.lit(1).alias("severity"), main.alias("main"), "top_score")
    first = notes.select(G.policy_notes(0.99)).first()[0]
    assert len(first) == 2 and first[0].startswith("Borderline match (similarity 1.000, threshold 0.99)") and "only 12 closed" in first[1]


@pytest.fixture(scope="module")
def src(spark, cases):
    r = G.route(G.apply_selection(G.similarity_gate(cases), picks(spark, [(0, 1, 3)])), drafts(spark, (0, 1, GOOD)))
    return G.with_sources(r.where("query_id = 0")).persist()


def check(spark, src, *items, opening="Sorry to hear that.", attempt=1):
    ready = src.select("query_id", F.map_keys("sources").alias("ids"), "numbers")
    d = drafts(spark, (0, attempt, (opening, ("Past tickets differ.", ["P1"]), list(items))))
    return G.check_drafts(d, ready).first()


def test_sources_block(src):
    r = src.first()
    hours = sorted(hours_of(i) for n in (18, 15, 12, 9) for i in range(n))
    middle = (hours[26] + hours[27]) / 2
    assert r.source_lines[0].startswith(
        f'[P1] Past closed tickets of type "{OPEN} / Refused at the gate": {SIZE[OPEN]} tickets; median time to close {middle:.1f} hours')
    assert r.source_lines[0].endswith("Share of tickets by recorded resolution: R1 (33%), R2 (28%), R3 (22%), R4 (17%).")
    assert r.source_lines[1] == '[R1] Recorded resolution: "The card was charged anew."'
    assert set(r.sources) == {"P1", "R1", "R2", "R3", "R4"} and r.sources["R1"].truncated_in_source is False


def test_rules_for_items(spark, src):
    got = check(spark, src, ("no citation", []), ("unknown", ["R99"]), ("took 9999 hours", ["P1"]), ("  ", ["P1"]),
                ("they will respond", ["P1"]), ("54 tickets, 33% alike, says R2", ["[P1]", " R1 "]))
    assert [s.text for s in got.steps] == ["54 tickets, 33% alike, says R2"] and got.steps[0].citations == ["P1", "R1"]
    assert [v.split(": ")[1].split(" ->")[0] for v in got.violations][:4] == [
        "no citation", "cites unknown source(s) ['R99']", "number(s) ['9999'] not found in the sources", "empty text"]
    assert got.violations[0] == 'steps[0]: no citation -> "no citation"' and "predicts the future" in got.violations[4]


def test_rules_for_openings(spark, src):
    assert check(spark, src, opening="It took 3 days.").opening == ""
    assert check(spark, src, opening="word " * 36).violations == ["opening: " + V.P_BAD_OPENING]
    assert check(spark, src, opening=" ").violations == ["opening: " + V.P_NO_OPENING]
    assert check(spark, src, opening="word " * 35).violations == []


def test_template_passes_the_rules(spark, src):
    a = src.select(G.template_answer(F.col("main"), F.col("rids")).alias("a")).first().a
    got = check(spark, src, *[(s.text, s.citations) for s in [a.summary, *a.steps]])
    assert got.violations == [] and len(got.steps) == 3


def test_remainder_line(src):
    two = F.array("rids")[0]
    lines = src.select(G.outcome_lines(F.col("main"), F.slice(two, 1, 2), 2)).first()[0]
    assert [x.text.split("%")[0] for x in lines] == ["33", "28", "39"] and lines[-1].text.endswith("(not listed individually).")
    assert lines[0].text == "33% of tickets: The card was charged anew." and lines[0].citations == ["P1", "R1"]


def test_attempts(spark, src):
    bad = (GOOD[0], GOOD[1], [("uncited", [])])
    worse = (GOOD[0], ("x", []), [("uncited", [])])
    ready = src.select("query_id", F.map_keys("sources").alias("ids"), "numbers")

    def best(*ds):
        c = G.check_drafts(drafts(spark, *[(0, i + 1, d) for i, d in enumerate(ds)]), ready)
        return G.best_attempt(c).first()

    r = best(bad, GOOD)
    assert (r.attempts, r.first_attempt_violations, r.best_attempt, r.violations) == (2, 1, 2, [])
    assert (best(bad, worse).best_attempt, best(GOOD, worse).attempts, best(bad, bad).best_attempt) == (1, 1, 1)
    fb = G.check_drafts(drafts(spark, (0, 1, bad)), ready).select(G.retry_feedback(F.col("violations"))).first()[0]
    assert fb == V.FEEDBACK_HEAD + '- steps[0]: no citation -> "uncited"'


def test_siblings_share_numbering(spark, cases):
    r = G.apply_selection(G.similarity_gate(cases), picks(spark, [(0, 1, 3)]))
    s = G.with_sources(G.route(r.where("query_id = 0"), drafts(spark, (0, 1, GOOD)), siblings=2)).first()
    kinds = [line[:4] for line in s.source_lines]
    assert kinds[:5] == ["[P1]", "[R1]", "[R2]", "[R3]", "[R4]"] and kinds.count("[P2]") == 1 and kinds.count("[P3]") == 1
    assert len(s.rids) == len(set(s.rids)) == sum(k.startswith("[R") for k in kinds)


def test_claims_and_prompts(spark, cases):
    a = G.answer_batch(cases, picks(spark, [(0, 1, 3)]), drafts(spark, (0, 1, GOOD)))
    c = G.claims(a.where("query_id = 0")).orderBy("id").collect()
    assert [(r.id, r.kind) for r in c] == [(1, "summary"), (2, "step")]
    block = cases.where("query_id = 2").select(G.candidate_block(F.col("hits"))).first()[0]
    assert block.startswith("1. Parcel / Arrived wet\n   agency evidence: A new parcel was sent.")


def test_triage_needs_no_outside_step(spark, history):
    got = {r.query_id: r for r in triage(complaints(spark, TEXTS), history.vectors, history.patterns, history.cards).collect()}
    assert got[3].abstained and got[3].answer is None and got[2].answer.steps[1].text.startswith("Set expectations")


def test_log_row_has_no_text(spark):
    r = spark.createDataFrame([("a", "secret words")], "k string, x string").select(T.log_row(F.col("k"), F.col("x")).alias("r")).first().r
    assert r.text_length == 12 and "secret" not in str(r)


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(2, 4, 10)], "a long, b long, n long")
    q = lambda p: df.select(M.histogram_quantile(p, [1.0, 2.0], [F.col("a"), F.col("b")], F.col("n"))).first()[0]
    assert (q(0.1), q(0.3), q(0.9)) == (0.5, 1.5, 2.0)


def test_stream_windows_equal_batch(spark, tmp_path):
    log = spark.range(400).select(
        (F.timestamp_seconds(1_700_000_000 + F.col("id") * 37)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 4 == 0).alias("abstained"),
        F.lit("none").alias("reason"), F.lit("llm").alias("method"), (F.col("id") % 3).cast("int").alias("first_attempt_violations"),
        (F.col("id") % 100 / 100).alias("top_score"), (F.col("id") % 50 * 300.0).alias("total_ms"))
    log.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = (stream_alert_windows(stream, "10 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    cols = ["window_end", "requests", "abstain_rate", "degraded", "alerts"]
    got = {r.window_end: tuple(r) for r in spark.read.parquet(out).select(F.col("window_end").cast("timestamp_ntz"), *cols[1:]).collect()}
    want = {r.window_end: tuple(r) for r in M.with_alerts(M.alert_windows(log, "10 minutes")).select(cols).collect()}
    assert 0 < len(got) <= len(want) and all(want[k] == v for k, v in got.items())


def test_alerts_wait_for_their_hold_time(spark):
    """Errors in four windows in a row fire from the second on; a gap starts anew."""
    rows = [(m, "internal error") for m in (1, 6, 11, 16, 41)] + [(m, "none") for m in range(0, 60, 2)]
    log = spark.createDataFrame(rows, "m int, reason string").select(
        (F.timestamp_seconds(F.lit(1_700_000_000 // 300 * 300) + F.col("m") * 60)).cast("timestamp_ntz").alias("ts"),
        F.lit(False).alias("abstained"), "reason", F.lit("llm").alias("method"), F.lit(0).alias("first_attempt_violations"),
        F.lit(0.9).alias("top_score"), F.lit(100.0).alias("total_ms"))
    got = [r.state for r in M.alert_states(log).where("alert = 'errors_present'").orderBy("window_end").collect()]
    assert got == ["pending", "firing", "firing", "firing", "pending"]


def test_report_has_reasons_tiers_methods_latency_and_what_passed(spark):
    low, none = "low_similarity (top cosine 0.100 < 0.4)", "llm_no_matching_candidate"
    rows = [  # id, inside, reason, tier, method, category, product, gold, attempts, first violations, remaining
        (1, True, None, "rag_core", "llm", "Ferry", "Late", "ferry", 1, 0, []),
        (2, True, None, "rag_core", "template", "Ferry", "Late", "Parcel", 2, 3, ["a"]),
        (3, True, None, "fast_lookup", "template", "Parcel", "Wet", "Parcel", 0, 0, []),
        (4, True, low, None, None, None, None, "Parcel", 0, 0, []), (5, True, none, None, None, None, None, "Parcel", 0, 0, []),
        (6, True, low, None, None, None, None, "Ferry", 0, 0, []), (7, False, low, None, None, None, None, None, 0, 0, []),
        *[(i, False, None, "rag_light", "llm", "Parcel", "Wet", None, 1, 0, []) for i in range(8, 18)]]
    a = spark.createDataFrame(
        [(i, d, r is not None, r, t, m, c, p, g, (m, n, f, left)) for i, d, r, t, m, c, p, g, n, f, left in rows],
        "query_id long, in_domain boolean, abstained boolean, abstain_reason string, tier string, method string, category string, "
        "product string, gold_type string, "
        "grounding struct<method:string,attempts:int,first_attempt_violations:int,remaining_violations:array<string>>")
    v = spark.createDataFrame([(1, 1, "supported"), (1, 2, "partial"), (2, 1, "supported"), (3, 1, "unsupported"), (9, 1, "supported")],
                              "query_id long, id int, verdict string")
    t = spark.createDataFrame([(1, {"total": 100.0, "retrieve": 10.0, "generate": 80.0}), (2, {"total": 300.0, "parse": 9.0}),
                               (3, {"total": 200.0, "retrieve": 5.0, "generate": None}), (4, {"total": 9000.0}), (9, {"total": 7000.0})],
                              "query_id long, stage_ms map<string,double>")
    r = M.generation_report(a, v, t).first().asDict()
    assert (r["n"], r["ood_n"], r["answered_pct"]) == (6, 11, 50.0)
    assert r["abstain_reasons"] == "llm_no_matching_candidate 1|low_similarity 2"
    assert r["tier_mix"] == "fast_lookup 1|rag_core 2" and r["by_method"] == "llm 1 2 50.0|template 2 2 50.0"
    assert (r["latency_p50_ms"], r["latency_p95_ms"]) == (200, 290)
    assert (r["mean_retrieve_ms"], r["mean_parse_ms"], r["mean_generate_ms"]) == (5, 3, 26)
    assert r["ood_reasons"] == "answered 10|low_similarity 1"
    assert r["ood_passed_through"] == "|".join(f"Parcel / Wet <- {i}" for i in range(8, 16))
    empty = M.generation_report(a.limit(0), v, t).first().asDict()
    assert (empty["n"], empty["tier_mix"], empty["latency_p50_ms"], empty["ood_passed_through"]) == (0, "", None, "")
    assert "latency_p50_ms" not in M.generation_report(a, v).columns
