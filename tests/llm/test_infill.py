"""Fill-in-the-middle against regular expressions, and the wavelet matrix against counting."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselore.llm import infill
from caselore.llm.wavelet import WaveletMatrix

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"}


@given(st.lists(st.integers(0, 15), max_size=300), st.data())
@settings(max_examples=60, deadline=None)
def test_rank_and_select(values, data):
    matrix = WaveletMatrix(np.array(values, np.uint8), 4)
    at = np.arange(len(values) + 1)
    for s in range(16):
        assert matrix.rank(s, at).tolist() == [values[:k].count(s) for k in at]
    wanted = data.draw(st.sets(st.integers(0, 15), min_size=1))
    seen = [sum(v in wanted for v in values[:k]) for k in at]
    found = matrix.select_any(wanted, at, np.zeros(len(at)), np.full(len(at), len(values)))
    assert found.tolist() == [next((k for k in range(len(values) + 1) if seen[k] >= c), len(values)) for c in at]


def plain_search(doc_id, text, unit="line", rate=100):
    units = re.findall(UNITS[unit], text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["", None, "\n", "\n\n\n", "a", "no end", "end\n", "ä\nöü\n\n日本語 の\nтекст", "one<P>two\n", "<M", "a\r\nb\x0bc\x0c\n", "😀\n😀",
       "x" * 3_000_000, "line of text\n" * 200_000, "  not a line end\u0085\n", "<S>"]


@pytest.mark.parametrize("unit", ["line", "word"])
def test_against_regular_expressions(spark, unit, monkeypatch):
    monkeypatch.setattr(infill, "SLICE", 1 << 18)
    rng = np.random.default_rng(5)
    texts = ODD + ["".join(rng.choice(list("ab é\n\n.日 \t"), rng.integers(0, 60))) for _ in range(400)]
    rows = [(None if i == 20 else i // 2, t, "clash", i) for i, t in enumerate(texts)]  # ids repeat
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    got = infill.transform(df, unit=unit)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted((str(i), *plain_search(i, t or "", unit)) for i, t, *_ in rows)
    found = sorted((str(r[0]), *r[1:]) for r in got.collect())
    assert str(found) == str(want)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert infill.restored(r[5], r[2]) in texts or r[5] == ""


def test_rate_digests_and_empty_table(spark):
    df = spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(200)], "doc_id long, text string")
    rows = infill.transform(df, rate=30).collect()
    assert sorted((r.doc_id, *r[1:]) for r in rows) == sorted((i, *plain_search(i, f"a{i}\nb\nc", rate=30)) for i in range(200))
    hashed = {r.doc_id: r for r in infill.digests(infill.transform(df)).collect()}
    for i in range(200):
        assert hashed[i].restored_sha256 == hashlib.sha256(f"a{i}\nb\nc".encode()).hexdigest()
        assert hashed[i].output_sha256 == hashlib.sha256(plain_search(i, f"a{i}\nb\nc")[4].encode()).hexdigest()
    assert infill.digests(infill.transform(df.limit(0))).collect() == []


def test_sentences():
    data = "One. Two 3.5 is! Last".encode()
    at = infill.Boundaries(np.frombuffer(data, np.uint8), np.array([0, len(data)]), "sentence")
    assert at.n.tolist() == [3]
    assert [data[:p].decode() for p in at.locate(np.zeros(4, int), np.arange(4))] == ["", "One.", "One. Two 3.5 is!", data.decode()]
