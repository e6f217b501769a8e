"""Triage that follows the state while it runs, and the counters of the service."""

from __future__ import annotations

from caselore.operators import clean as C
from caselore.operators import monitor as M
from caselore.plans import ingest as I
from caselore.session import fresh_path
from caselore.sources import state as S
from caselore.streaming import jobs as J
from conftest import complaints, tickets
from test_history import FRESH, FRESH_SIZE, MORE, MORE_SIZE

ASKED = ["ticket machine keeps the coin", "ferry crossing missed"]


def test_a_running_stream_sees_a_new_version(spark):
    root, inbox, out = (fresh_path(spark, n) for n in ("state", "inbox", "out"))
    I.init_state(spark, root, C.clean_tickets(tickets(spark)))
    asked = complaints(spark, ASKED).select("query_id", "embedding")
    asked.write.parquet(inbox)
    index = J.LiveIndex(root)
    q = J.triage_with(J.ticket_files(spark, inbox, asked.schema), index, out, fresh_path(spark, "cp"), gate=0.7, processingTime="0 seconds")
    try:
        q.processAllAvailable()
        first, prepared = index.v, index.index
        I.apply_batch(spark, root, tickets(spark, FRESH, "B"))
        asked.selectExpr("query_id + 10 as query_id", "embedding").write.mode("append").parquet(inbox)
        q.processAllAvailable()
    finally:
        q.stop()
    assert (first, index.v) == (0, 1) and index.index is not prepared
    got = {r.query_id: r for r in spark.read.parquet(f"{out}/micro_batch=0", f"{out}/micro_batch=1").collect()}
    ids = sorted(got)
    new = {r.complaint_type: r.pattern_id for r in S.current(spark, root).patterns.collect()}["Ticket machine"]
    before, after = got[ids[0]], got[ids[2]]
    assert before.state_version == 0 and before.pattern_id != new
    assert after.state_version == 1 and after.pattern_id == new and not after.abstained
    assert got[ids[1]].pattern_id == got[ids[3]].pattern_id
    assert index.at(spark)[0] is index.index
    index.release()
    assert index.index is None


def test_service_counters(spark):
    root = fresh_path(spark, "state")
    I.init_state(spark, root, C.clean_tickets(tickets(spark)))
    I.apply_batch(spark, root, tickets(spark, FRESH, "B"))
    I.apply_batch(spark, root, tickets(spark, MORE, "C"))
    log = spark.createDataFrame([("none",), ("internal error",), (None,), ("internal error",)], "reason string")
    got = {r.metric: r.n for r in M.service_counters(log, S.audit(spark, root)).collect()}
    assert got == {"errors_total": 2, "ingested_tickets_total": FRESH_SIZE + MORE_SIZE, "new_patterns_total": 1}
