"""Token counts by prefix dynamic programming: one pass over a text stores the exact count of every prefix.

``prefix_table`` keeps, for each text, the change of the count with each character (one signed byte as a rule). Every
later question - how many tokens has a prefix, how long may a text be for a budget - is a running sum over that
column; nothing is encoded again.

Defined results: a null text is empty (0 tokens, 0 bytes); an empty text has no prefixes; texts are never cut; a
special string inside a text counts as its one token from its last character on; repeated rows and ids give a row each;
null ids pass through; columns other than the two named ones are not read, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_map, slices

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _counter(path: str):
    if path not in _counter.__dict__:
        _counter.__dict__[path] = bpe.PrefixCounts(bpe.Vocabulary(path))
    return _counter.__dict__[path]


def _binary(changes: np.ndarray) -> bytes:
    """Signed bytes behind a width mark; eight bytes each where one change is larger."""
    return bytes([changes.dtype.itemsize]) + changes.tobytes()


def _counts(stored: bytes | None) -> np.ndarray:
    if not stored:
        return np.zeros(0, np.int64)
    return np.cumsum(np.frombuffer(stored, f"<i{stored[0]}", offset=1), dtype=np.int64)


def _fits(changes: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens, from the counts of all prefixes."""
    within = np.flatnonzero(np.cumsum(changes, dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_table(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                 keep_prefixes: bool = True, budget: int = 512) -> DataFrame:
    """A row for each row of ``df``: its id, n_bytes, n_tokens, ``fits_chars`` (how many characters from the begin have at most
    ``budget`` tokens) and ``prefixes`` (null if they are not kept)."""
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.octet_length(F.coalesce(F.col(text_column), F.lit("")))
                     .cast("long").alias("n_bytes"), F.col(text_column).alias("text"))

    def count(batches):
        changes = _counter(path).changes
        for part in slices(batches, 2):
            found = [changes(t or "") for t in part.column(2).to_pylist()]
            yield [part.column(0), part.column(1), pa.array([int(x.sum(dtype=np.int64)) for x in found], pa.int64()),
                   pa.array([_fits(x, budget) for x in found], pa.int64()),
                   pa.array([_binary(x) if keep_prefixes else None for x in found], pa.binary())]

    return arrow_map(rows, count, f"`{id_column}` {kind}, n_bytes long, n_tokens long, fits_chars long, prefixes binary")


def prefix_tokens(prefixes: str, n_chars: str):
    """Column: tokens of the first ``n_chars`` characters (of the whole text if it is shorter)."""
    @F.pandas_udf("long")
    def tokens(stored, chars):
        import pandas as pd

        out = []
        for s, n in zip(stored, chars, strict=True):
            c = _counts(s)
            n = min(max(int(n) if n == n and n is not None else 0, 0), len(c))
            out.append(int(c[n - 1]) if n else 0)
        return pd.Series(out, dtype="int64")

    return tokens(F.col(prefixes), F.col(n_chars))


def longest_prefix(prefixes: str, budget: int):
    """Column: characters of the longest prefix with at most ``budget`` tokens (counts can fall as a text grows)."""
    @F.pandas_udf("long")
    def chars(stored):
        import pandas as pd

        fits = (np.flatnonzero(_counts(s) <= budget) for s in stored)
        return pd.Series([int(f[-1]) + 1 if len(f) else 0 for f in fits], dtype="int64")

    return chars(F.col(prefixes))


def token_counts(df: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """n_tokens, n_bytes and ``over_limit`` of each text, from the count at its last prefix, and ``fits_chars``: where to
    cut the text so that it keeps to the limit, from the counts of the others."""
    return prefix_table(df, path, id_column, text_column, keep_prefixes=False, budget=limit).select(
        id_column, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits_chars")
