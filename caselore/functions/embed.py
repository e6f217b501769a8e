"""Vector expressions: hashed bag of words, normalisation, query prefix."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .text import tokens

Embed = Callable[[Column], Column]


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    # The one-element array computes the norm once per row instead of once per element.
    scaled = F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))
    return F.element_at(scaled, 1)


def _bucket_vectors(dim: int):
    @F.arrow_udf("array<double>")
    def vectors(buckets: pa.Array) -> pa.Array:
        flat = buckets.flatten().to_numpy(zero_copy_only=False)
        lengths = np.asarray(buckets.value_lengths().fill_null(0))
        row = np.repeat(np.arange(len(buckets)), lengths)
        dense = np.bincount(row * dim + flat, minlength=len(buckets) * dim).astype("float64").reshape(-1, dim)
        norm = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
        unit = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)
        offsets = pa.array(np.arange(0, (len(buckets) + 1) * dim, dim, dtype="int32"))
        return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))

    return vectors


def hash_embed(text: Column, dim: int = V.EMBED_DIM) -> Column:
    """Bag of words hashed into ``dim`` buckets (md5), unit length. Hashing runs in the JVM, counting on Arrow batches.

    As many of the last hex digits are read as ``dim`` needs, two at least.
    """
    if dim < 1 or dim > 1 << 24 or dim & (dim - 1):
        raise ValueError("dim must be a power of two up to 2^24")
    digits = max(2, -(-(dim.bit_length() - 1) // 4))
    buckets = F.transform(
        tokens(F.coalesce(text, F.lit(""))),
        lambda t: F.conv(F.substring(F.md5(t), 33 - digits, digits), 16, 10).cast("int") % dim)
    return _bucket_vectors(dim)(buckets)


def query_text(text: Column, model: str) -> Column:
    """Some models expect an instruction ahead of a query (never ahead of a document)."""
    return F.concat(F.lit(V.RETRIEVAL_PREFIX if model in V.PREFIX_MODELS else ""), text)
