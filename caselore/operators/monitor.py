"""Counters, histograms and alerts over the answer log; reports over judged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numbers import fixed_places, round_half_even
from ..functions.ranking import exact_percentiles


def ask_metrics(log: DataFrame) -> DataFrame:
    """All counters of the log in one pass: (metric, label1, label2, n)."""
    reason = F.when(F.col("abstained"), F.coalesce(F.nullif(F.substring_index(F.coalesce("reason", F.lit("")), " ", 1), F.lit("")),
                                                   F.lit("none"))).otherwise("none")
    outcome = F.when(F.col("abstained"), "abstained").otherwise("answered")
    answered = ~F.col("abstained")
    none = F.lit("")

    def row(metric: str, when: Column, label1: Column, label2: Column = none, n: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(metric).alias("metric"), label1.alias("label1"), label2.alias("label2"),
                                     (F.lit(1) if n is None else n).cast("bigint").alias("n")))

    yes = F.lit(True)
    rows = F.array(
        row("requests", yes, outcome, reason), row("tier", answered, F.coalesce("tier", F.lit("unknown"))),
        row("method", answered, F.coalesce("method", F.lit("unknown"))),
        row("severity", answered & F.col("severity").isNotNull(), F.col("severity").cast("string")),
        row("tokens", yes, F.lit("prompt_tokens"), n=F.col("prompt_tokens")),
        row("tokens", yes, F.lit("completion_tokens"), n=F.col("completion_tokens")),
        row("first_attempt_violations", answered & (F.col("first_attempt_violations") > 0), none))
    return (log.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")
            .groupBy("metric", "label1", "label2").agg(F.sum("n").alias("n")))


def service_counters(log: DataFrame, batches: DataFrame) -> DataFrame:
    """(metric, n): failed requests of the log, and what the batches of a state's audit have brought in all."""
    errors = log.agg(F.lit("errors_total").alias("metric"), F.count_if(F.col("reason") == "internal error").alias("n"))
    sums = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("ingested", "new_patterns")])
    rows = F.array(F.struct(F.lit("ingested_tickets_total").alias("metric"), F.col("ingested").alias("n")),
                   F.struct(F.lit("new_patterns_total").alias("metric"), F.col("new_patterns").alias("n")))
    return errors.unionByName(sums.select(F.inline(rows)))


def histogram_le(df: DataFrame, value: Column, buckets: list[float], keys: tuple = ()) -> DataFrame:
    """Cumulative bucket counts with +Inf, sum and count. Bounds become columns of one aggregate, not joined rows."""
    bounds = [*buckets, float("inf")]
    aggs = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    agg = df.groupBy(*keys).agg(*aggs, F.count(value).alias("count"), F.sum(value).alias("sum"))
    rows = F.array(*[F.struct(F.lit("+Inf" if b == float("inf") else str(b)).alias("le"),
                              (F.col("count") if b == float("inf") else F.col(f"b{i}")).alias("bucket_count"))
                     for i, b in enumerate(bounds)])
    return agg.select(*keys, F.explode(rows).alias("r"), "count", "sum").select(*keys, "r.*", "count", "sum")


def histogram_quantile(q: float, buckets: list[float], counts: list[Column], total: Column) -> Column:
    """Quantile by linear interpolation inside the bucket where the rank falls; the last bound if it lies beyond."""
    rank = total * F.lit(float(q))
    out = None
    for i, b in enumerate(buckets):
        low = F.lit(float(buckets[i - 1])) if i else F.lit(0.0)
        below = counts[i - 1] if i else F.lit(0)
        at = low + (F.lit(float(b)) - low) * (rank - below) / F.nullif(counts[i] - below, F.lit(0))
        at = F.coalesce(at, F.lit(float(b)))
        out = F.when(counts[i] >= rank, at) if out is None else out.when(counts[i] >= rank, at)
    return F.when(total > 0, out.otherwise(F.lit(float(buckets[-1]))))


SLIDE = "5 minutes"


def _signals() -> dict[str, Column]:
    """What is counted per window. Counts add up, so they can be taken per pane and summed."""
    answered = ~F.col("abstained")
    out = {
        "requests": F.lit(True), "abstained": F.col("abstained"), "answered": answered,
        "degraded": answered & (F.col("method") == "template_degraded"),
        "retries": answered & (F.col("first_attempt_violations") > 0), "errors": F.col("reason") == "internal error"}
    out.update({f"l{i}": F.col("total_ms") / 1000 <= b for i, b in enumerate(V.LATENCY_BUCKETS)})
    out.update({f"c{i}": F.col("top_score") <= b for i, b in enumerate(V.COSINE_BUCKETS)})
    return out


def _rates(w: DataFrame) -> DataFrame:
    n = F.col("requests")
    return w.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests",
        (F.col("abstained") / n).alias("abstain_rate"),
        histogram_quantile(0.5, V.COSINE_BUCKETS, [F.col(f"c{i}") for i in range(len(V.COSINE_BUCKETS))], n)
        .alias("median_top_score"),
        "degraded", (F.col("retries") / F.nullif(F.col("answered"), F.lit(0))).alias("retry_rate"),
        histogram_quantile(0.95, V.LATENCY_BUCKETS, [F.col(f"l{i}") for i in range(len(V.LATENCY_BUCKETS))], n)
        .alias("p95_latency"), "errors")


def log_panes(log: DataFrame, slide: str = SLIDE) -> DataFrame:
    """The log counted once per slide. Every window length is a sum of these few rows."""
    return log.groupBy(F.window("ts", slide).alias("p")).agg(
        *[F.count_if(c).alias(n) for n, c in _signals().items()]).withColumn("start", F.col("p.start")).drop("p")


def windows_of_panes(panes: DataFrame, window: str, slide: str = SLIDE) -> DataFrame:
    names = [c for c in panes.columns if c != "start"]
    return _rates(panes.groupBy(F.window("start", window, slide).alias("w")).agg(*[F.sum(c).alias(c) for c in names]))


def alert_windows(log: DataFrame, window: str, slide: str = SLIDE) -> DataFrame:
    """All signals per sliding window; the length must be a multiple of the slide.

    Log rows are not copied into every window they belong to: panes are.
    """
    return windows_of_panes(log_panes(log, slide), window, slide)


def alert_windows_direct(log: DataFrame, window: str, slide: str = SLIDE) -> DataFrame:
    """The same in one aggregation, the form a stream needs."""
    return _rates(log.groupBy(F.window("ts", window, slide).alias("w")).agg(
        *[F.count_if(c).alias(n) for n, c in _signals().items()]))


def with_alerts(windows: DataFrame) -> DataFrame:
    """Which limits a window breaks."""
    rules = [(name, F.col(signal) > limit if sign == ">" else F.col(signal) < limit)
             for name, (signal, sign, limit, _, _) in V.ALERT_RULES.items()]
    fired = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules]), lambda x: x.isNotNull())
    return windows.withColumn("alerts", fired)


ALERT_WINDOWS = {name: rule[3] for name, rule in V.ALERT_RULES.items()}


def window_alerts(log: DataFrame) -> DataFrame:
    """(window, alert) rows: every rule over its own window length."""
    panes = log_panes(log)
    parts = None
    for length in sorted(set(ALERT_WINDOWS.values())):
        rules = [r for r, w in ALERT_WINDOWS.items() if w == length]
        w = with_alerts(windows_of_panes(panes, length)).select(
            "window_start", "window_end", F.explode(F.filter("alerts", lambda a: a.isin(rules))).alias("alert"))
        parts = w if parts is None else parts.unionByName(w)
    return parts


def alert_states(log: DataFrame, slide_minutes: int = 5) -> DataFrame:
    """(alert, window_end, since, state): a broken rule is pending, and firing once it has been broken for its hold time.

    Rules are judged every five minutes, at the ends of their windows; a window in which the rule is kept, or without any
    request, starts the count anew. There are as many rows as broken windows, whatever the log holds.
    """
    broken = window_alerts(log).select("alert", F.col("window_end").alias("at"))
    order = Window.partitionBy("alert").orderBy("at")
    step = F.expr(f"interval {slide_minutes} minutes")
    starts = F.when(F.lag("at").over(order) == F.col("at") - step, 0).otherwise(1)
    runs = broken.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    runs = runs.withColumn("since", F.min("at").over(Window.partitionBy("alert", "run")))
    hold = F.create_map(*[x for name, rule in V.ALERT_RULES.items() for x in (F.lit(name), F.lit(rule[4]))])[F.col("alert")]
    held = F.timestamp_diff("MINUTE", F.col("since"), F.col("at"))
    return runs.select("alert", F.col("at").alias("window_end"), "since",
                       F.when(held >= hold, "firing").otherwise("pending").alias("state"))


def stage_histogram(log: DataFrame) -> DataFrame:
    """Latency histogram per stage, in seconds; ``stage_ms`` maps a stage to its milliseconds, "total" among them."""
    staged = log.select(F.explode("stage_ms").alias("stage", "ms")).where("ms is not null")
    return histogram_le(staged, F.col("ms") / 1000, V.LATENCY_BUCKETS, ("stage",))


def stage_means(log: DataFrame) -> DataFrame:
    """Mean milliseconds of each stage over the answered requests, by method."""
    staged = log.where(~F.col("abstained")).select("method", F.explode("stage_ms").alias("stage", "ms")).where("ms is not null")
    return staged.groupBy("method", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"))


# --- report over answers ---


def _listing(rows: DataFrame, key: str, *shown: str) -> Column:
    """A handful of rows as one text, ``a 3|b 5``, in order of the key; empty without rows."""
    texts = rows.select(F.col(key).alias("key"), F.concat_ws(" ", *shown).alias("text")).agg(
        F.array_sort(F.collect_list(F.struct("key", "text"))).alias("all"))
    return texts.select(F.array_join(F.transform("all", lambda x: x["text"]), "|")).scalar()


def answer_latency(answers: DataFrame, timings: DataFrame) -> dict[str, Column]:
    """p50 and p95 of the answered complaints and the mean of each stage, whole milliseconds; a stage that did not run took none.

    ``timings``: query_id, stage_ms, which maps a stage to its milliseconds, "total" among them.
    """
    t = answers.where(~F.col("abstained")).select("query_id").join(timings.select("query_id", "stage_ms"), "query_id").select(
        F.lit(1).alias("all"), *[F.try_element_at("stage_ms", F.lit(s)).alias(s) for s in ("total", *V.REPORT_STAGES)])
    p = exact_percentiles(t, ["all"], "total", {"p50": 0.5, "p95": 0.95}, width=50.0)
    means = t.agg(*[F.floor(F.round(F.avg(F.coalesce(s, F.lit(0.0))), 6)).alias(s) for s in V.REPORT_STAGES])
    return {**{f"latency_{c}_ms": p.select(F.floor(c)).scalar() for c in ("p50", "p95")},
            **{f"mean_{s}_ms": means.select(s).scalar() for s in V.REPORT_STAGES}}


def generation_report(answers: DataFrame, verdicts: DataFrame, timings: DataFrame | None = None, let_through: int = 8) -> DataFrame:
    """Health of a batch of answers, one row: shares, reasons, tiers and methods, judged items, latency, and the out-of-domain set.

    ``answers``: abstained, abstain_reason, tier, method, category, product, gold_type, in_domain, grounding.
    ``verdicts``: query_id, id, verdict (with the default applied). ``timings``: as ``answer_latency`` takes them; without them
    the report has no latency columns.
    """
    a = answers.where(F.coalesce("in_domain", F.lit(True)))
    per = verdicts.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("verdict") == "supported").alias("ok"),
        F.count_if(F.col("verdict") == "partial").alias("partial"))
    j = a.join(per, "query_id", "left")
    answered = ~F.col("abstained")
    drafted = answered & ((F.col("method") == "llm") | (F.col("grounding.attempts") > 0))
    right = F.lower("category") == F.lower("gold_type")

    def pct(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, round_half_even(100 * part / whole, 1))

    n, m, d = F.count(F.lit(1)), F.count_if(answered), F.count_if(drafted)
    items = F.sum(F.when(answered, F.coalesce("items", F.lit(0))).otherwise(0))
    s = j.agg(
        n.alias("n"), pct(m, n).alias("answered_pct"),
        pct(F.count_if(answered & right), n).alias("end_to_end_category_acc_pct"),
        pct(F.count_if(answered & right), m).alias("category_acc_when_answered_pct"),
        pct(F.count_if(drafted & (F.col("grounding.first_attempt_violations") > 0)), d).alias("first_attempt_violation_pct"),
        pct(F.count_if(drafted & (F.size("grounding.remaining_violations") > 0)), d).alias("remaining_violation_pct"),
        F.count_if(answered & (F.col("method") == "template") & (F.col("tier") != "fast_lookup")).alias("template_fallbacks"),
        pct(F.sum(F.when(answered, F.col("ok"))), items).alias("supported_pct"),
        pct(F.sum(F.when(answered, F.col("partial"))), items).alias("partial_pct"),
        pct(F.sum(F.when(answered, F.col("items") - F.col("ok") - F.col("partial"))), items).alias("unsupported_pct"),
        pct(F.count_if(answered & (F.col("items") == F.col("ok"))), m).alias("fully_supported_pct"))
    out = answers.where(~F.coalesce("in_domain", F.lit(True)))
    reason = F.substring_index("abstain_reason", " ", 1)
    by = method_report(answers, verdicts).withColumn("pct", F.when(F.col("items") > 0, fixed_places(F.col("supported_pct"), 1)))
    passed = out.where(answered).select("query_id", F.concat(
        F.coalesce("category", F.lit("")), F.lit(" / "), F.coalesce("product", F.lit("")), F.lit(" <- "), F.col("query_id").cast("string")
    ).alias("line")).orderBy("query_id", "line").limit(let_through)
    return s.withColumns({
        "abstain_reasons": _listing(a.where("abstained").groupBy(reason.alias("k")).count(), "k", "k", "count"),
        "tier_mix": _listing(a.where(answered).groupBy("tier").count(), "tier", "tier", "count"),
        "by_method": _listing(by, "method", "method", "answers", "items", "pct"),
        **(answer_latency(a, timings) if timings is not None else {}),
        "ood_n": out.agg(F.count(F.lit(1))).scalar(),
        "ood_abstained_pct": out.agg(pct(F.count_if("abstained"), F.count(F.lit(1)))).scalar(),
        "ood_reasons": _listing(out.groupBy(F.when(F.col("abstained"), reason).otherwise("answered").alias("k")).count(), "k", "k", "count"),
        "ood_passed_through": _listing(passed, "query_id", "line")})


def report_breakdowns(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counts by abstain reason, tier and method, and supported items per method."""
    a = answers.where(F.coalesce("in_domain", F.lit(True)))
    reason = F.substring_index("abstain_reason", " ", 1)
    rows = F.filter(F.array(
        F.when(F.col("abstained"), F.struct(F.lit("abstain_reason").alias("section"), reason.alias("key"))),
        F.when(~F.col("abstained"), F.struct(F.lit("tier").alias("section"), F.col("tier").alias("key"))),
        F.when(~F.col("abstained"), F.struct(F.lit("method").alias("section"), F.col("method").alias("key")))),
        lambda r: r.isNotNull())
    counts = a.select(F.explode(rows).alias("r")).groupBy("r.section", "r.key").agg(F.count(F.lit(1)).alias("n"))
    by = verdicts.join(a.where(~F.col("abstained")).select("query_id", "method"), "query_id").groupBy("method").agg(
        F.count_if(F.col("verdict") == "supported").alias("n"))
    return counts.unionByName(by.select(F.lit("supported_items").alias("section"), F.col("method").alias("key"), "n"))


def method_report(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per method: answers, judged items, supported items and their percentage."""
    a = answers.where(F.coalesce("in_domain", F.lit(True)) & ~F.col("abstained"))
    per = verdicts.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("verdict") == "supported").alias("ok"))
    s = a.select("query_id", "method").join(per, "query_id", "left").groupBy("method").agg(
        F.count(F.lit(1)).alias("answers"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("supported"))
    return s.withColumn("supported_pct", F.when(F.col("items") > 0, round_half_even(100 * F.col("supported") / F.col("items"), 1)))


def outside_report(answers: DataFrame, set_name: Column, let_through: int = 5) -> DataFrame:
    """For each set of questions outside the domain: n, abstained %, rows per reason, and the first ids let through."""
    a = answers.where(~F.coalesce("in_domain", F.lit(True))).withColumn("set_name", set_name)
    reason = F.substring_index("abstain_reason", " ", 1)
    first = a.where(~F.col("abstained")).withColumn("place", F.row_number().over(Window.partitionBy("set_name").orderBy("query_id")))
    shown = first.where(F.col("place") <= let_through).groupBy("set_name").agg(
        F.array_join(F.array_sort(F.collect_list("query_id")), "|").alias("let_through"))
    per = a.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n"), round_half_even(100 * F.count_if("abstained") / F.count(F.lit(1)), 1).alias("abstained_pct"),
        *[F.count_if(F.col("abstained") & (reason == r)).alias(r) for r in V.ABSTAIN_REASONS])
    return per.join(shown, "set_name", "left").withColumn("let_through", F.coalesce("let_through", F.lit("")))


def latency_report(log: DataFrame) -> DataFrame:
    """p50 and p95 of the answered requests per method, whole milliseconds, and the mean."""
    a = log.where(~F.col("abstained"))
    q = exact_percentiles(a, ["method"], "total_ms", {"p50": 0.5, "p95": 0.95}, width=50.0)
    mean = a.groupBy("method").agg(F.floor(F.round(F.avg("total_ms"), 6)).alias("mean_ms"))
    return q.select("method", F.floor("p50").alias("p50_ms"), F.floor("p95").alias("p95_ms")).join(mean, "method")
