from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caselore.operators import changes as D
from caselore.operators import clean as C
from caselore.operators import patterns as P
from caselore.operators import vectors as X
from caselore.plans import base_queries as B
from caselore.plans import history_queries as H
from caselore.plans import ingest as I
from caselore.plans import search_queries as Q
from caselore.plans import shared
from caselore.plans import stream_queries as ST
from caselore.session import fresh_path
from caselore.sources import state as S
from caselore.sources import tickets as K
from caselore.streaming import jobs as J
from conftest import COLUMNS, OPEN, PLAN, SETTLED, SIZE, SPLIT, TOTAL, tickets


def raw(spark, **changes):
    row = {"unique_key": "1", "created_date": "2025-03-01T10:00:00", "closed_date": "2025-03-01T12:00:00",
           "complaint_type": "Noise", "descriptor": "Drums", "descriptor_2": "x", "resolution_description": "Done.",
           "status": "Closed", **changes}
    return spark.createDataFrame([tuple(row.values())], COLUMNS)


def test_cleaning_rules(spark):
    rows = [raw(spark), raw(spark, descriptor_2=" n/A "), raw(spark, status="Open"), raw(spark, resolution_description="N/A"),
            raw(spark, complaint_type="  "), raw(spark, closed_date="soon"), raw(spark, closed_date="2025-03-01T09:00:00"),
            raw(spark, descriptor=" \tN/A ")]
    df = K.union_all(rows)
    clean = C.clean_tickets(df)
    got = clean.toPandas()
    assert len(got) == 5 and C.clean_funnel(df).first().asDict() == {"raw_rows": 8, "closed": 7, "with_resolution": 6, "usable": 5}
    assert sorted(got.descriptor_2) == ["", "x", "x", "x", "x"]
    assert sorted(got.close_hours.dropna()) == [-1.0, 2.0, 2.0, 2.0] and "N/A" in set(got.descriptor)
    assert C.clean_tickets(df.drop("status")).count() == 6


def test_csv_eats_missing_tokens(spark):
    df = K.union_all([raw(spark, unique_key="a", descriptor="N/A"), raw(spark, unique_key="b", descriptor=" N/A "),
                      raw(spark, unique_key="c", descriptor="none"), raw(spark, unique_key="d", descriptor='say "hi",\nthere')])
    path = fresh_path(spark, "csv")
    K.write_csv(df, path)
    back = K.read_tickets_csv(spark, path, multi_line=True)
    assert {r.unique_key: r.descriptor for r in back.collect()} == {"a": None, "b": " N/A ", "c": "none", "d": 'say "hi",\nthere'}
    assert {r.unique_key for r in C.clean_tickets(back).collect()} == {"b", "c", "d"}


def test_tiers(spark, history):
    edges = spark.createDataFrame([(0.95, 30), (0.95, 29), (0.5, 10), (0.49, 1000), (0.89996, 50)], "s double, n long")
    assert [r[0] for r in edges.select(P.assign_tier(F.col("s"), F.col("n"))).collect()] == [
        "fast_lookup", "rag_light", "rag_light", "rag_core", "rag_light"]
    tiers = {r.complaint_type: r.tier for r in history.patterns.collect()}
    assert tiers == {OPEN: "rag_core", SPLIT: "rag_light", SETTLED: "fast_lookup"}


def test_shares_sum_to_one_and_nest(spark, history):
    o = P.outcome_table(history.counts)
    assert all(abs(r.s - 1) < 1e-9 for r in o.groupBy("pattern_id").agg(F.sum("share_raw").alias("s")).collect())
    nested = P.nest_outcomes(o, page=2).collect()
    assert sorted((r.page_no, len(r.resolution_dist)) for r in nested) == [(0, 2), (0, 2), (0, 2), (1, 1), (1, 2)]


def test_contract(spark):
    good = raw(spark)
    assert K.check_contract(good)["extra_columns"] == 1
    with pytest.raises(ValueError, match="missing required"):
        K.check_contract(good.drop("descriptor"))
    with pytest.raises(ValueError, match="1 to 2"):
        K.check_contract(K.union_all([good, good, good]), max_rows=2)
    with pytest.raises(ValueError):
        K.check_contract(good.limit(0))


def test_resume_and_lines(spark):
    items = spark.range(5).withColumnRenamed("id", "k")
    assert [r.k for r in K.resume_todo(items, spark.range(2).withColumnRenamed("id", "k"), "k", limit=4).orderBy("k").collect()] == [2, 3]
    path = fresh_path(spark, "lines")
    spark.createDataFrame([("a",), ("  ",), ("",), ("b",)], "value string").write.text(path)
    assert sorted(r.value for r in K.read_lines(spark, path).collect()) == ["a", "b"]


# A batch: one class nobody has seen, and more tickets of the class without a majority.
FRESH = [("Ticket machine", "Keeps the coin", "The coin was returned.", 21), ("Ticket machine", "Keeps the coin", "The machine was emptied.", 8)]
MORE = [(OPEN, "Refused at the gate", "A fee was still open.", 17)]
FRESH_SIZE, MORE_SIZE = 29, 17


@pytest.fixture()
def state(spark):
    root = fresh_path(spark, "state")
    return root, I.init_state(spark, root, C.clean_tickets(tickets(spark)))


def test_batch_equals_rebuild(spark, state):
    root, old = state
    batch = tickets(spark, FRESH + MORE, "B")
    report = I.apply_batch(spark, root, batch)
    s = report.summary.first()
    assert (s.ingested, s.duplicates_skipped, s.new_patterns, s.updated_patterns, s.new_resolutions) == (46, 0, 1, 1, 2)
    assert [r.pattern for r in report.new_patterns.collect()] == [f"Ticket machine. Keeps the coin (n={FRESH_SIZE})"]
    now = S.current(spark, root)
    whole = P.build_patterns(C.clean_tickets(tickets(spark).unionByName(batch)))
    assert sorted(map(tuple, now.patterns.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert now.vectors.count() == 4 and old.patterns.count() == 3 and old.tickets.count() == TOTAL


def test_replay_and_repeats(spark, state):
    root, _ = state
    again = I.apply_batch(spark, root, tickets(spark)).summary.first()
    assert (again.ingested, again.duplicates_skipped) == (0, TOTAL) and S.current(spark, root).v == 0
    one = raw(spark, unique_key="twice")
    both = one.unionByName(one)
    assert I.apply_batch(spark, root, both).summary.first().ingested == 2
    clean = C.clean_tickets(both)
    assert D.dedupe_against_state(clean, clean.limit(0), dedupe_within_batch=True).count() == 1
    assert S.audit(spark, root).count() == 1


def test_examples_index_new_classes(spark, state):
    root, _ = state
    batch = tickets(spark, FRESH, "B")
    pid = C.clean_tickets(batch).first().pattern_id
    ex = spark.createDataFrame([(pid, [f"the machine ate coin {i}" for i in range(20)]), ("unknown", ["x"])], K.EXAMPLE_SCHEMA)
    s = I.apply_batch(spark, root, batch, examples=ex).summary.first()
    assert s.examples_generated == 20 and s.index_vectors == 3 + 16
    assert X.id_check(S.current(spark, root).vectors).first().ids_unique
    assert S.current(spark, root).doc_format == I.WITH_EXAMPLES


def test_doc_format_stays(spark, state):
    root, _ = state
    I.apply_batch(spark, root, tickets(spark, FRESH, "B"))
    assert S.current(spark, root).doc_format == I.LABEL_ONLY


def test_model_mismatch_is_refused(spark, state):
    with pytest.raises(ValueError, match="index built with"):
        I.apply_batch(spark, state[0], tickets(spark, FRESH, "B"), model="other")
    assert S.current(spark, state[0]).v == 0


def test_second_first_load_is_refused(spark, state):
    root, _ = state
    I.apply_batch(spark, root, tickets(spark, FRESH, "B"))
    with pytest.raises(ValueError, match="already holds version 1"):
        I.init_state(spark, root, C.clean_tickets(tickets(spark, MORE, "C")))
    assert S.current(spark, root).tickets.count() == TOTAL + FRESH_SIZE


def test_only_a_missing_folder_means_no_state(spark, tmp_path):
    assert S.current(spark, str(tmp_path / "nothing")) is None
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        S.current(spark, "nosuchscheme://x/y")


def test_audit_belongs_to_committed_versions(spark, state):
    root, _ = state
    I.apply_batch(spark, root, tickets(spark, FRESH + MORE, "B"))
    row = S.audit(spark, root).first()
    assert (row.v, row.new_patterns, row.updated_patterns, row.closed) == (1, 1, 1, 46)
    kinds = {(r.change, r.pattern): (r.tier_from, r.tier_to) for r in S.audit_changes(spark, root).collect()}
    assert kinds["new", f"Ticket machine. Keeps the coin (n={FRESH_SIZE})"] == (None, "rag_light")
    # an attempt that died before its commit leaves an audit nobody sees
    spark.range(1).selectExpr("9L as received").write.json(f"{root}/audit/v=2")
    assert S.audit(spark, root).count() == 1
    I.apply_batch(spark, root, tickets(spark, FRESH, "C"))
    assert sorted(r.v for r in S.audit(spark, root).collect()) == [1, 2]
    assert {r.received for r in S.audit(spark, root).collect()} == {46, FRESH_SIZE}


def test_uncommitted_files_stay_invisible(spark, state):
    root, _ = state
    S.put(C.clean_tickets(tickets(spark, FRESH, "B")), root, "tickets", 1, S.new_attempt())
    assert S.current(spark, root).tickets.count() == TOTAL
    I.apply_batch(spark, root, tickets(spark, MORE, "C"))
    assert S.current(spark, root).tickets.count() == TOTAL + MORE_SIZE


def test_stream_equals_batch(spark, state):
    root, _ = state
    other = fresh_path(spark, "state")
    I.init_state(spark, other, C.clean_tickets(tickets(spark)))
    batch = tickets(spark, FRESH + PLAN[:2], "B")
    I.apply_batch(spark, other, batch)
    inbox = fresh_path(spark, "inbox")
    batch.repartition(2).write.parquet(inbox)
    q = J.stream_ingest(J.ticket_files(spark, inbox, batch.schema, 1), root, fresh_path(spark, "cp"))
    q.awaitTermination()
    a, b = S.current(spark, root), S.current(spark, other)
    assert a.v == 2 and b.v == 1 and b.tickets.count() == TOTAL + FRESH_SIZE + SIZE[SETTLED]
    assert sorted(map(tuple, a.patterns.collect())) == sorted(map(tuple, b.patterns.collect()))


def test_tv_and_transitions(spark):
    p = spark.createDataFrame([("k", "a", 0.5), ("k", "b", 0.5)], "pattern_id string, resolution_id string, share double")
    q = spark.createDataFrame([("k", "a", 0.25), ("k", "c", 0.75)], p.schema)
    assert D.tv_distance(p, q, ["pattern_id"]).first().tv == 0.75
    assert D.tv_distance(p, p, ["pattern_id"]).first().tv == 0.0


def test_hysteresis(spark):
    make = lambda rows: spark.createDataFrame(rows, "pattern_id string, complaint_type string, descriptor string, descriptor_2 string, total_cases long, tier string, top1_raw double")
    old = make([("p", "a", "b", "", 50, "rag_light", 0.51), ("q", "a", "c", "", 50, "rag_light", 0.6)])
    new = make([("p", "a", "b", "", 60, "rag_core", 0.495), ("q", "a", "c", "", 60, "rag_core", 0.4)])
    assert D.tier_changes(new, old).count() == 2
    assert [r.pattern_id for r in D.tier_changes(new, old, margin=0.02).collect()] == ["q"]


def test_many_new_tickets_meet_the_state_at_once(spark, monkeypatch):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("d", 5)], "unique_key string, n int")
    state = spark.createDataFrame([("b",), ("b",), (None,), ("c",)], "unique_key string")
    found = []
    for limit in (D.SHIP_KEYS, 0):
        monkeypatch.setattr(D, "SHIP_KEYS", limit)
        out = D.dedupe_against_state(batch, state)
        found.append(sorted(r.n for r in out.collect()))
    assert found == [[1, 2, 5]] * 2
    monkeypatch.setattr(D, "SHIP_KEYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D.dedupe_against_state(batch, state)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # each side once


def small_tables(spark, path):
    """Parcels ordered before and after the cutoff, in the tables the tickets are made of."""
    day = "timestamp_ntz '2000-{}-02 00:00:00'"
    spark.range(60).selectExpr(
        "id as l_orderkey", "1 as l_linenumber", "id % 6 as l_partkey", "id % 3 as l_suppkey", "0.0 as l_discount", "0.0 as l_tax",
        f"{day.format('11')} as l_shipdate", "cast(id % 50 as int) as l_quantity", "'R' as l_returnflag", "'F' as l_linestatus",
    ).write.parquet(f"{path}/lineitem.parquet")
    spark.range(60).selectExpr(
        "id as o_orderkey", f"if(id % 4 = 0, {day.format('08')}, {day.format('03')}) as o_orderdate", "'1-URGENT' as o_orderpriority",
        "'F' as o_orderstatus").write.parquet(f"{path}/orders.parquet")
    spark.range(6).selectExpr("id as p_partkey", "cast(id + 1 as int) as p_size", "'SMALL' as p_type", "concat('Brand ', id % 3) as p_brand",
                              "'crate' as p_name").write.parquet(f"{path}/part.parquet")
    return path


def test_tickets_are_read_once_for_counts_and_state(spark, tmp_path):
    shared.forget()
    sf = small_tables(spark, str(tmp_path))
    for query in (B.dist_explode_query, B.rank_outcomes, Q.self_retrieval_check):
        scans = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_linenumber" not in scans and "unique_key" not in scans
    assert {name for _, _, name in shared._STORED} == {"outcome-counts"}
    assert sorted(r.n for r in B.dist_explode_query(spark, sf).collect()) == [1, 1, 1]
    assert {r.itself for r in Q.self_retrieval_check(spark, sf).collect()} <= {True, False}
    root, state = H.base_state(spark, sf)
    assert state.tickets.count() == 45 and {name for _, _, name in shared._STORED} == {"outcome-counts"}
    assert ST.stream_ingest(spark, sf).agg(F.sum("total_cases")).first()[0] == 60


def test_a_streamed_batch_is_not_kept_in_memory(spark, state, tmp_path, monkeypatch):
    root, _ = state
    tickets(spark, FRESH, "B").write.parquet(str(tmp_path / "in"))
    kept = []
    monkeypatch.setattr(J, "apply_batch", lambda s, root, batch, **k: kept.append(batch.is_cached))
    J.stream_ingest(J.ticket_files(spark, str(tmp_path / "in"), tickets(spark).schema), root, str(tmp_path / "check")).awaitTermination()
    assert kept == [False]
