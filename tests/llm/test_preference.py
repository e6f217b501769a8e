"""Preference formatting against a plain version."""

from caselore.llm import preference as P

COLUMNS = "pair_id long, turn long, role string, text string, loss int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], COLUMNS).repartition(3)


def plain(chosen, rejected):
    out = []
    clean = lambda rows, k: sorted((P.LAST if t is None else t, r or "", x or "") for p, t, r, x in rows if p == k)
    for k in {r[0] for r in chosen + rejected}:
        a, b = clean(chosen, k), clean(rejected, k)
        ends = [t for t in {x[0] for x in a + b} if [x for x in a if x[0] == t] != [x for x in b if x[0] == t]]
        end = min(ends, default=None)
        for side, rows in (("chosen", a), ("rejected", b)):
            for t, r, x in rows:
                common = end is None or t < end
                if common and side == "rejected":
                    continue
                out.append((k, "prompt" if common else side, t, r, f"<|{r}|>\n{x}<|end|>\n", not common and r == "assistant"))
    return sorted(out, key=str)


CHOSEN = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "good"),
          (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "x"), (None, 0, "user", None),
          (None, None, "assistant", "late"), (4, 0, None, ""), (4, 0, None, ""), (5, 0, "user", "only chosen"),
          (7, 0, "user", "w" * 100_000), (7, 1, "assistant", "y")]
REJECTED = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"),
            (1, 4, "user", "why"), (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "x"),
            (3, 1, "assistant", "longer"), (None, 0, "user", None), (None, None, "assistant", "other"), (4, 0, None, ""),
            (6, 0, "user", "only rejected"), (7, 0, "user", "w" * 100_000), (7, 1, "assistant", "z")]


def test_segments(spark):
    got = P.segments(frame(spark, CHOSEN), frame(spark, REJECTED)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(CHOSEN, REJECTED)
    none = frame(spark, CHOSEN).where("turn < 0")
    assert P.segments(none, none).collect() == []


def test_examples(spark):
    rows = {r.pair_id: r for r in P.examples(P.segments(frame(spark, CHOSEN), frame(spark, REJECTED))).collect()}
    r = rows[1]
    assert r.prompt == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nmore<|end|>\n"
    assert r.chosen == "<|assistant|>\ngood<|end|>\n" and [tuple(s) for s in r.chosen_loss] == [(0, len(r.chosen))]
    assert [r.rejected[a:b] for a, b in r.rejected_loss] == ["<|assistant|>\nbad<|end|>\n"]
    assert rows[2].chosen == "" and rows[2].rejected == "" and rows[3].chosen == ""


def test_pairs_of_any_length(spark):
    """Whole parts and exact spans, in one row or in many."""
    long = [(9, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(1200)]
    other = [(p, t, r, "else" if t == 900 else x) for p, t, r, x in long]
    parts = P.segments(frame(spark, CHOSEN + long), frame(spark, REJECTED + other))
    for row_chars in (1 << 20, 5000, 30):
        rows = {}
        for r in P.pairs(parts, row_chars).collect():
            rows.setdefault(r.pair_id, []).append(r)
        want = {r.pair_id: r for r in P.examples(parts).collect()}
        assert set(rows) == set(want)
        for k, got in rows.items():
            got.sort(key=lambda r: r.piece)
            assert {r.n_pieces for r in got} == {len(got)}
            for name in ("prompt", "chosen", "rejected"):
                assert "".join(r[name] for r in got) == want[k][name]
            for name in ("chosen_loss", "rejected_loss"):
                assert [tuple(x) for r in got for x in r[name]] == [tuple(x) for x in want[k][name]]
            assert row_chars < 5000 or max(len(r.prompt) for r in got) <= row_chars + 400 or k == 7
        assert len(rows[1]) == 1 or row_chars == 30


def test_no_python_in_the_plan(spark):
    plan = P.pairs(P.segments(frame(spark, CHOSEN), frame(spark, REJECTED)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_swapped_replies(spark):
    talks = [(0, 0, "user", "u"), (0, 1, "assistant", "a0"), (1, 0, "user", "v"), (1, 1, "assistant", "a1"), (1, 2, "user", "end"),
             (2, 0, "user", "w"), (2, 1, "assistant", "a2"), (3, 0, "user", "no reply"), (None, 0, "user", "n")]
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    _, rejected = P.swapped_replies(df)
    got = {(r.pair_id, r.turn): r.text for r in rejected.collect()}
    assert got[0, 1] == "a1" and got[1, 1] == "a0" and (2, 1) not in got and got[3, 0] == "no reply" and got[None, 0] == "n"
