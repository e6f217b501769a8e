"""Token counts and packing against the tokenizer library."""

import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from caselore.llm import bpe, packing, token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = bpe.PrefixCounts(bpe.Vocabulary(PATH))
ENCODER = bpe.Vocabulary(PATH).encoder()
PIECES = ["a", " the", "  ", "\n", "\n\n", "'", "'re", "'ll", "'s", "don't", "12", " 3", "!", "!!", "é", "ñ", "日本", "😀",
          "<|endoftext|>", "<|end", "\t", "hello", "World", "　", "|", "lowei", "ueñ"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join))
def test_count_of_every_prefix(text):
    counts = np.cumsum(COUNTER.changes(text), dtype=np.int64)
    assert list(counts) == [len(ids(text[:i + 1])) for i in range(len(text))]
    assert ENCODER.encode(text, allowed_special="all") == ids(text)


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n", "a \t"])
def test_long_runs_take_linear_time(run):
    text = (run * 1_000_000)[:1_000_000]
    began = time.process_time()
    changes = COUNTER.changes(text)
    assert time.process_time() - began < 5
    assert int(changes.sum(dtype=np.int64)) == len(ids(text))
    for n in (1, 2, 63, 64, 65, 1000):  # prefixes too, and a run in front of a word
        assert int(COUNTER.changes(run * n + "x").sum(dtype=np.int64)) == len(ids(run * n + "x"))


def rows(spark):
    texts = [None, "", "one", "one", "two words\n", "x " * 5000, "Ünïcode 日本 <|endoftext|> end", "a" * 3000]
    return spark.createDataFrame([(i if i else None, t, "extra", 7) for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_tokens string, n int").repartition(3)


def test_table_answers(spark):
    kept = token_counts.prefix_table(rows(spark), PATH)
    got = {r.doc_id: r for r in kept.withColumn("n", token_counts.F.lit(40)).select(
        "*", token_counts.prefix_tokens("prefixes", "n").alias("first40"),
        token_counts.longest_prefix("prefixes", 3).alias("fits3")).collect()}
    for r in rows(spark).collect():
        text, g = r.text or "", got[r.doc_id]
        assert (g.n_bytes, g.n_tokens) == (len(text.encode()), len(ids(text)))
        assert g.first40 == len(ids(text[:40]))
        assert len(ids(text[:g.fits_chars])) <= 512 and (g.fits_chars == len(text) or len(ids(text[:g.fits_chars + 1])) > 512)
        assert len(ids(text[:g.fits3])) <= 3 and (g.fits3 == len(text) or len(ids(text[:g.fits3 + 1])) > 3)
    over = {r.doc_id: r.over_limit for r in token_counts.token_counts(rows(spark), PATH).collect()}
    assert over[5] and not over[1]
    cut = {r.doc_id: r.fits_chars for r in token_counts.token_counts(rows(spark), PATH, limit=100).collect()}
    assert cut[5] == next(k for k in range(400, 0, -1) if len(ids(("x " * 5000)[:k])) <= 100) and cut[1] == 0
    assert token_counts.token_counts(rows(spark).where("doc_id < 0"), PATH).collect() == []


def test_packing_round_trip(spark):
    df = rows(spark)
    pieces = packing.pack(df, PATH, window=64)
    got = pieces.collect()
    want = {r.doc_id: ids(r.text or "") + [0] for r in df.collect()}
    by_doc, by_window = {}, {}
    for p in got:
        assert zlib.crc32(p.piece) == p.ids_crc32 and len(p.piece) == 4 * p.length
        by_doc.setdefault(p.doc_id, []).append((p.start, list(np.frombuffer(p.piece, "<u4"))))
        by_window.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert p.doc_tokens == len(want[p.doc_id])
    assert {d: [x for _, part in sorted(v) for x in part] for d, v in by_doc.items()} == want
    total = sum(map(len, want.values()))
    assert sorted(by_window) == list(range(-(-total // 64)))
    for s, parts in by_window.items():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end == 64 or s == max(by_window)
    whole = packing.sequences(pieces, window=64).collect()
    assert sum(r.n_ids for r in whole) == total
    for r in whole:
        assert len(r.ids) == (256 if r.n_ids & (r.n_ids - 1) else 4 * r.n_ids)
    assert packing.pack(df.where("doc_id < 0"), PATH).collect() == []
