"""From hits to answers: gates, routing, numbered sources, drafts checked against them, templates, notes.

Everything about one complaint stays in its row: at most ten hits with five outcomes each. Outside decisions
(which candidate fits, drafted text, verdicts) arrive as tables and are joined by ``query_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as T
from ..functions.numbers import fixed_places, format_duration, let, percent_text, round_half_even
from ..session import materialise

SIBLING_OUTCOMES = 2
HITS = ("hits", "picked", "siblings")  # what the sources are made of; nothing after them reads it
TEXT_LIMIT, EVIDENCE_LIMIT = 700, 110
ITEM = "struct<text:string,citations:array<string>>"


def _label(h: Column) -> Column:
    return T.candidate_label(*[h[c] for c in V.LABELS])


def _raw_join(sep: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), sep)


def collect_hits(queries: DataFrame, ranked: DataFrame, cards: DataFrame) -> DataFrame:
    """One row per complaint with its hits in order (empty if there are none)."""
    fields = ["rank", "pattern_id", "score", *V.LABELS, "tier", "total_cases", "top1_share", "median_close_hours",
              "p90_close_hours", "resolutions"]
    per = ranked.select("query_id", "rank", "pattern_id", "score").join(cards, "pattern_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"))
    out = queries.join(per, "query_id", "left")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(per.schema["hits"].dataType)))


# --- gates and routing ---


def similarity_gate(cases: DataFrame, gate: float = V.GATE) -> DataFrame:
    """Too far from everything known: abstain, but keep the candidates."""
    top = F.coalesce(F.get("hits", F.lit(0))["score"], F.lit(0.0))
    low = (F.size("hits") == 0) | (top < gate)
    reason = F.concat(F.lit("low_similarity (top cosine "), fixed_places(top, 3), F.lit(f" < {gate})"))
    return cases.withColumns({
        "top_score": top, "low": low, "abstain_reason": F.when(low, reason),
        "candidates": F.transform("hits", lambda h: F.struct(
            _label(h).alias("label"), round_half_even(h["score"], 3).alias("score")))})


def candidate_block(hits: Column) -> Column:
    def line(h: Column, i: Column) -> Column:
        first = F.coalesce(F.get(h["resolutions"], F.lit(0))["text"], F.lit(""))
        return F.concat((i + 1).cast("string"), F.lit(". "), _label(h), F.lit("\n   agency evidence: "),
                        T.shorten(first, EVIDENCE_LIMIT))

    return F.array_join(F.transform(hits, line), "\n")


def apply_selection(gated: DataFrame, selections: DataFrame) -> DataFrame:
    """The picked hit; 0 or a number beyond the candidates means that none fits."""
    s = selections.select("query_id", "selected_candidate", "confidence", "severity", "sentiment",
                          F.col("selected_candidate").isNotNull().alias("has_selection"))
    j = gated.join(s, "query_id", "left")
    asked = ~F.col("low") & F.coalesce("has_selection", F.lit(False))
    choice = F.col("selected_candidate")
    valid = asked & (choice >= 1) & (choice <= F.size("hits"))
    picked = F.when(valid, F.get("hits", F.greatest(choice - 1, F.lit(0))))
    j = j.withColumns({"asked": asked, "picked": picked,
                       "selected_rank": F.when(asked, F.when(valid, choice).otherwise(0))})
    return j.withColumns({
        "abstain_reason": F.when(asked & ~valid, F.lit("llm_no_matching_candidate")).otherwise(F.col("abstain_reason")),
        "severity": F.when(asked, F.col("severity")), "sentiment": F.when(asked, F.col("sentiment")),
        "confidence": F.when(asked, F.col("confidence"))}).drop("has_selection")


def route(picked: DataFrame, drafted: DataFrame | None, siblings: int = 0) -> DataFrame:
    """Who answers: template for consistent histories, a checked draft otherwise, the nearest match if the outside
    step is missing."""
    has = F.lit(False)
    if drafted is not None:
        picked = picked.join(drafted.select("query_id", F.lit(True).alias("has_draft")), "query_id", "left")
        has = F.coalesce("has_draft", F.lit(False))
    fast = F.col("picked")["tier"] == "fast_lookup"
    degraded = ~F.col("low") & (~F.col("asked") | (F.col("picked").isNotNull() & ~fast & ~has))
    main = F.when(degraded, F.get("hits", F.lit(0))).otherwise(F.col("picked"))
    out = picked.withColumns({"degraded": degraded, "main": main}).drop("has_draft")
    core = (F.col("main")["tier"] == "rag_core") & ~F.col("degraded")
    others = F.filter("hits", lambda h: h["pattern_id"] != F.col("main")["pattern_id"])
    return out.withColumns({
        "abstained": F.col("main").isNull(),
        "planned": F.when(F.col("degraded"), "template_degraded").when(F.col("main")["tier"] == "fast_lookup", "template")
        .when(F.col("main").isNotNull(), "llm"),
        "n_res": F.when(core, 5).otherwise(3),
        "siblings": F.when(core, F.slice(others, 1, siblings) if siblings else F.slice(others, 1, 0))
        .otherwise(F.slice(others, 1, 0))})


# --- sources ---


def build_sources(main: Column, siblings: Column, n_res: Column) -> Column:
    """Numbered sources: ``struct<lines, rids, items>``.

    P1 is the main pattern, P2.. its siblings; an outcome gets its R number where it is first listed.
    """
    blocks = F.concat(F.array(F.struct(main.alias("hit"), n_res.alias("k"))),
                      F.transform(siblings, lambda s: F.struct(s.alias("hit"), F.lit(SIBLING_OUTCOMES).alias("k"))))
    shown = F.transform(blocks, lambda b: F.slice(b["hit"]["resolutions"], F.lit(1), b["k"]))
    ids = F.transform(F.flatten(shown), lambda r: r["resolution_id"])
    return F.struct(blocks.alias("blocks"), shown.alias("shown"), F.array_distinct(ids).alias("rids"))


def _rid(rids: Column, resolution: Column) -> Column:
    return F.concat(F.lit("R"), F.array_position(rids, resolution).cast("string"))


def with_sources(routed: DataFrame) -> DataFrame:
    """Adds ``rids``, ``source_lines``, ``source_block``, ``numbers`` and the ``sources`` map."""
    s = routed.withColumn("src", F.when(F.col("main").isNotNull(), build_sources(F.col("main"), F.col("siblings"), F.col("n_res"))))
    rids = F.col("src.rids")

    def pattern_line(b: Column, i: Column) -> Column:
        h = b["hit"]
        refs = F.transform(F.get(F.col("src.shown"), i), lambda r: F.concat(
            _rid(rids, r["resolution_id"]), F.lit(" ("), percent_text(r["share"]), F.lit(")")))
        return T.filled(V.PATTERN_LINE, i + 1, _label(h), h["total_cases"], format_duration(h["median_close_hours"]),
                        format_duration(h["p90_close_hours"]), F.array_join(refs, ", "))

    def outcome_line(r: Column) -> Column:
        return F.concat(T.filled(V.OUTCOME_LINE, _rid(rids, r["resolution_id"]), T.shorten(r["text"], TEXT_LIMIT, " ...")),
                        F.when(T.is_truncated(r["text"]), V.CUT_NOTE).otherwise(""))

    def block_lines(b: Column, i: Column) -> Column:
        earlier = F.transform(F.flatten(F.slice(F.col("src.shown"), F.lit(1), i)), lambda r: r["resolution_id"])
        first_seen = F.filter(F.get(F.col("src.shown"), i), lambda r: ~F.array_contains(earlier, r["resolution_id"]))
        return F.concat(F.array(pattern_line(b, i)), F.transform(first_seen, outcome_line))

    none = F.lit(None).cast("string")

    def item(ident, kind, pattern=none, label=none, resolution=none, text=none, cut=F.lit(None).cast("boolean")):
        return F.struct(ident.alias("key"), F.struct(
            F.lit(kind).alias("kind"), pattern.alias("pattern_id"), label.alias("label"), resolution.alias("resolution_id"),
            text.alias("text"), cut.alias("truncated_in_source")).alias("value"))

    patterns = F.transform(F.col("src.blocks"), lambda b, i: item(
        F.concat(F.lit("P"), (i + 1).cast("string")), "pattern", b["hit"]["pattern_id"], _label(b["hit"])))
    listed = F.flatten(F.col("src.shown"))
    outcomes = F.transform(rids, lambda x: F.transform(F.filter(listed, lambda r: r["resolution_id"] == x), lambda r: item(
        _rid(rids, x), "resolution", resolution=x, text=r["text"], cut=T.is_truncated(r["text"]))))
    firsts = F.transform(outcomes, lambda o: F.get(o, F.lit(0)))
    s = s.withColumns({
        "rids": rids, "source_lines": F.flatten(F.transform(F.col("src.blocks"), block_lines)),
        "sources": F.map_from_entries(F.concat(patterns, firsts))})
    s = s.withColumn("source_block", F.array_join("source_lines", "\n"))
    return s.withColumn("numbers", F.array_distinct(T.numbers_in(F.col("source_block")))).drop("src")


# --- rendered parts ---


def _item(text: Column, *citations: Column) -> Column:
    return F.struct(text.alias("text"), F.array(*citations).alias("citations"))


def outcome_lines(main: Column, rids: Column, n: int = 4) -> Column:
    """The most frequent outcomes as facts, each cited, and what the shown ones leave over."""
    listed = F.filter(F.slice(main["resolutions"], 1, n), lambda r: F.array_contains(rids, r["resolution_id"]))

    def render(shown: Column) -> Column:
        lines = F.transform(shown, lambda r: _item(
            T.filled(V.OUTCOME_SHARE, percent_text(r["share"]), T.first_sentences(r["text"], 1)),
            F.lit("P1"), _rid(rids, r["resolution_id"])))
        left = round_half_even(1 - F.aggregate(shown, F.lit(0.0), lambda a, r: a + r["share"]), 2)
        more = let(left, lambda rest: F.when(rest >= V.REMAINDER_MIN, F.array(_item(
            T.filled(V.OUTCOME_SHARE, percent_text(rest), F.lit(V.REMAINDER_TEXT)), F.lit("P1")))))
        return F.concat(lines, F.coalesce(more, F.array().cast(f"array<{ITEM}>")))

    return let(listed, render)


def template_answer(main: Column, rids: Column) -> Column:
    top = F.get(main["resolutions"], F.lit(0))
    rid = _rid(rids, top["resolution_id"])
    return F.struct(
        F.lit("").alias("opening"),
        _item(T.filled(V.SUMMARY, percent_text(top["share"]), main["total_cases"]), F.lit("P1"), rid).alias("summary"),
        F.array(
            _item(T.filled(V.STEP_RESOLVED, T.first_sentences(top["text"], 2)), rid),
            _item(T.filled(V.STEP_TIMES, format_duration(main["median_close_hours"]), format_duration(main["p90_close_hours"])),
                  F.lit("P1"))).alias("steps"),
        outcome_lines(main, rids, 3).alias("outcomes"))


# --- checking drafts ---


def _listed(values: Column) -> Column:
    quoted = F.transform(values, lambda v: F.when(v.contains("'") & ~v.contains('"'), F.concat(F.lit('"'), v, F.lit('"')))
                         .otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def bare_citations(citations: Column) -> Column:
    return F.transform(citations, T.bare_citation)


def item_problem(text: Column, citations: Column, ids: Column, numbers: Column) -> Column:
    """The first rule a drafted item breaks, or null."""
    cites = bare_citations(citations)
    unknown = F.filter(cites, lambda c: ~F.array_contains(ids, c))
    stray = F.filter(T.numbers_in(text), lambda n: ~F.array_contains(numbers, n))
    return (F.when(T.strip(text) == "", V.P_EMPTY).when(F.size(cites) == 0, V.P_UNCITED)
            .when(F.size(unknown) > 0, F.concat(F.lit("cites unknown source(s) "), _listed(unknown)))
            .when(F.size(stray) > 0, F.concat(F.lit("number(s) "), _listed(stray), F.lit(" not found in the sources")))
            .when(T.is_prediction(text), V.P_PREDICTS))


def opening_problem(text: Column) -> Column:
    too_long = F.size(T.words(text)) > V.OPENING_MAX_WORDS
    return (F.when(T.strip(text) == "", V.P_NO_OPENING)
            .when(text.rlike("(?U)" + V.NUMBER) | too_long, V.P_BAD_OPENING))


def check_drafts(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """Each draft with only its valid parts and the list of its violations.

    ``sources`` has one row per complaint: ``query_id, ids, numbers``.
    """
    j = drafts.join(sources.select("query_id", "ids", "numbers"), "query_id")

    def checked(item: Column) -> Column:
        return F.struct(item["text"].alias("raw"), T.strip(item["text"]).alias("text"),
                        bare_citations(item["citations"]).alias("citations"),
                        item_problem(item["text"], item["citations"], F.col("ids"), F.col("numbers")).alias("problem"))

    j = j.withColumns({"o": opening_problem(F.col("opening")), "s": checked(F.col("summary")),
                       "t": F.transform("steps", checked)})

    def violation(where: Column, item: Column) -> Column:
        return F.concat(where, F.lit(": "), item["problem"], F.lit(' -> "'), F.substring(item["raw"], 1, 80), F.lit('"'))

    all_v = F.concat(
        F.array(F.concat(F.lit("opening: "), F.col("o")), violation(F.lit("summary"), F.col("s"))),
        F.transform("t", lambda x, i: violation(F.concat(F.lit("steps["), i.cast("string"), F.lit("]")), x)))
    keep = lambda x: F.struct(x["text"].alias("text"), x["citations"].alias("citations"))
    return j.select(
        "query_id", "attempt",
        F.when(F.col("o").isNull(), T.strip(F.col("opening"))).otherwise("").alias("opening"),
        F.when(F.col("s.problem").isNull(), keep(F.col("s"))).alias("summary"),
        F.transform(F.filter("t", lambda x: x["problem"].isNull()), keep).alias("steps"),
        F.filter(all_v, lambda v: v.isNotNull()).alias("violations"))


def retry_feedback(violations: Column) -> Column:
    lines = F.transform(F.slice(violations, 1, 8), lambda v: F.concat(F.lit("- "), v))
    return F.when(F.size(violations) > 0, F.concat(F.lit(V.FEEDBACK_HEAD), F.array_join(lines, "\n")))


def best_attempt(checked: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Fewest violations wins, the earlier on ties; attempts after a clean one do not count."""
    per = checked.where(F.col("attempt") <= max_attempts).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "attempt", F.size("violations").alias("n"), "opening", "summary", "steps", "violations"))).alias("all"))
    clean = F.array_position(F.transform("all", lambda a: a["n"]), 0).cast("int")
    used = F.when(clean > 0, F.slice("all", F.lit(1), clean)).otherwise(F.col("all"))
    per = per.select("query_id", used.alias("used"))
    least = F.array_min(F.transform("used", lambda a: a["n"]))
    best = F.get(F.filter("used", lambda a: a["n"] == least), F.lit(0))
    return per.select(
        "query_id", F.size("used").alias("attempts"), F.get("used", F.lit(0))["n"].alias("first_attempt_violations"),
        best.alias("best")).select(
        "query_id", "attempts", "first_attempt_violations", F.col("best.attempt").alias("best_attempt"), "best.opening",
        "best.summary", "best.steps", "best.violations")


# --- notes and the whole batch ---


def policy_notes(gate: float = V.GATE) -> Column:
    """Notes in fixed order; degraded answers carry only their own note."""
    score = F.col("top_score")
    cases = F.col("main")["total_cases"]
    border = T.filled(V.BORDERLINE_NOTE, fixed_places(score, 3), F.lit(str(gate)))
    little = T.filled(V.LITTLE_NOTE, cases)
    high = T.filled(V.SEVERE_NOTE, F.col("severity"))
    notes = F.array(F.when(score < gate + V.BORDERLINE_MARGIN, border), F.when(cases < 30, little),
                    F.when(F.col("severity") >= 4, high), F.when(F.col("severity") >= 5, V.EMERGENCY_NOTE))
    answered = F.filter(notes, lambda n: n.isNotNull())
    return (F.when(F.col("main").isNull(), F.array().cast("array<string>"))
            .when(F.col("degraded"), F.array(F.lit(V.DEGRADED_NOTE))).otherwise(answered))


def answer_batch(cases: DataFrame, selections: DataFrame, drafts: DataFrame, gate: float = V.GATE, siblings: int = 0,
                 max_attempts: int = 2) -> DataFrame:
    """Complaints with hits -> answers. Two joins by complaint bring in the outside picks and drafts."""
    routed = route(apply_selection(similarity_gate(cases, gate), selections), drafts.select("query_id").distinct(), siblings)
    # Search, gates and sources are read twice from here on: written once, so that no search runs twice.
    src = materialise(with_sources(routed).drop(*HITS), "sources", compression="zstd")
    ready = src.where(F.col("planned") == "llm").select("query_id", F.map_keys("sources").alias("ids"), "numbers")
    best = best_attempt(check_drafts(drafts, ready), max_attempts).withColumnRenamed("violations", "remaining")
    return finish_answers(src, best, gate)


def finish_answers(src: DataFrame, best: DataFrame, gate: float) -> DataFrame:
    j = src.join(best, "query_id", "left")
    usable = (F.col("planned") == "llm") & F.col("summary").isNotNull() & (F.size("steps") > 0)
    main, rids = F.col("main"), F.col("rids")
    drafted = F.struct(F.coalesce("opening", F.lit("")).alias("opening"), F.col("summary").alias("summary"),
                       F.col("steps").alias("steps"), outcome_lines(main, rids, 4).alias("outcomes"))
    method = F.when(F.col("planned") == "llm", F.when(usable, "llm").otherwise("template")).otherwise(F.col("planned"))
    answer = F.when(main.isNotNull(), F.when(usable, drafted).otherwise(template_answer(main, rids)))
    tidy = lambda c: T.tidy_label(main[c])
    keep = [c for c in ("complaint", "in_domain", "gold_pattern", "gold_type") if c in src.columns]
    severity = F.when(~F.col("degraded"), F.col("severity"))
    return j.select(
        "query_id", *keep, "abstained", F.when(F.col("abstained"), F.col("abstain_reason")).alias("abstain_reason"),
        "top_score", F.when(main.isNotNull(), tidy("complaint_type")).alias("category"),
        F.when(main.isNotNull(), T.candidate_label(main["descriptor"], main["descriptor_2"])).alias("product"),
        severity.alias("severity"), F.when(~F.col("degraded"), F.col("sentiment")).alias("sentiment"),
        main["tier"].alias("tier"), main["pattern_id"].alias("pattern_id"), method.alias("method"), answer.alias("answer"),
        "sources", "source_block", policy_notes(gate).alias("policy_notes"), "candidates",
        F.struct(method.alias("method"), F.coalesce("attempts", F.lit(0)).alias("attempts"),
                 F.coalesce("first_attempt_violations", F.lit(0)).alias("first_attempt_violations"),
                 F.coalesce("remaining", F.array().cast("array<string>")).alias("remaining_violations")).alias("grounding"))


def claims(answers: DataFrame) -> DataFrame:
    """The summary and the steps as numbered claims; opening and outcomes are not up for judgement."""
    kinds = F.concat(F.array(F.struct(F.lit("summary").alias("kind"), F.col("answer.summary.text").alias("text"))),
                     F.transform("answer.steps", lambda s: F.struct(F.lit("step").alias("kind"), s["text"].alias("text"))))
    c = answers.where(~F.col("abstained")).select("query_id", F.posexplode(kinds).alias("pos", "c"))
    return c.select("query_id", (F.col("pos") + 1).alias("id"), "c.kind", "c.text")


# --- texts for the outside steps ---


def selection_prompt(complaint: Column, hits: Column) -> Column:
    return T.filled(V.SELECTION_PROMPT, complaint, candidate_block(hits))


def draft_prompt(complaint: Column, hit: Column, severity: Column, sentiment: Column, block: Column) -> Column:
    return T.filled(V.DRAFT_PROMPT, complaint, hit["complaint_type"], _raw_join(" / ", hit["descriptor"], hit["descriptor_2"]),
                    severity, sentiment, block)


def judge_prompt(block: Column, texts: Column) -> Column:
    listing = F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    return T.filled(V.JUDGE_PROMPT, block, F.array_join(listing, "\n"))


def example_prompt(label: Column, n: int = 4) -> Column:
    return T.filled(V.EXAMPLE_PROMPT, label, F.lit(n))
