"""Hold times of alerts on a stream, over a restart, against the batch version."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caselore.operators import monitor as M
from caselore.session import fresh_path
from caselore.streaming import alerts as J

LOG = "ts timestamp, abstained boolean, reason string, method string, first_attempt_violations int, total_ms double, top_score double"
START = dt.datetime(2025, 3, 1, 10)


def log(spark, rows):
    """(minute, errors?, abstained?, slow?) rows."""
    return spark.createDataFrame([
        (START + dt.timedelta(minutes=m), abstained, "internal error" if error else "none", "llm", 0, 30_000.0 if slow else 900.0, 0.9)
        for m, error, abstained, slow in rows], LOG)


def test_states_over_a_restart(spark):
    """An error spell, a gap without requests, a slow spell that goes on over the restart, then quiet."""
    first = [(m, 20 <= m < 33, False, m >= 70) for m in range(0, 80, 1) if not 40 <= m < 60]
    second = [(m, False, m >= 100, m < 95) for m in range(80, 150)]
    inbox, root = fresh_path(spark, "log"), fresh_path(spark, "alerts")
    for part in (first, second):
        log(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(log(spark, part).schema).parquet(inbox)
        for q in J.start_alerts(stream, root):
            assert q.exception() is None
    got = {(r.alert, r.window_end, r.since, r.state) for r in spark.read.parquet(f"{root}/states").collect()}
    end = START + dt.timedelta(minutes=149 - 10)
    want = {(r.alert, r.window_end, r.since, r.state) for r in M.alert_states(log(spark, first + second)).where(
        F.col("window_end") <= F.lit(end)).collect()}
    assert {g for g in got if g[3] != "resolved"} == want
    names = {(a, s) for a, *_, s in got}
    assert {("slow_answers", "firing"), ("slow_answers", "resolved"), ("errors_present", "firing"), ("errors_present", "resolved"),
            ("high_abstain_rate", "pending")} <= names
    broken = {(a, e) for a, e, _, _ in want}
    step = dt.timedelta(minutes=5)
    ends = {(a, e + step, s) for a, e, s, _ in want if (a, e + step) not in broken and e + step <= START + dt.timedelta(minutes=135)}
    assert {g[:3] for g in got if g[3] == "resolved"} == ends and len(ends) >= 2
