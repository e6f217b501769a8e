"""Concatenate and cut: all texts become one long run of token ids, cut into windows of a fixed length.

Pass 1 encodes each text once, writes the ids and, in the same task, where the text starts among the task's ids.
Pass 2 adds up the totals of the tasks (one row a task, whatever the data) to the global offset of each task; every
piece then follows from offsets alone, so no text or id is shuffled. A window that lies across the edge of a task gets
boundary records from both sides; only those meet in a shuffle when windows are put together.

Defined results: a null text is an empty one and gives the separator alone; empty tables give no pieces; repeated ids
and rows are packed as often as they occur; the last window may be short; very long texts run over as many windows as
they need; no other columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_map, slices, written

WINDOW = 1024
SEPARATOR = 0


def _vocabulary(path: str):
    if path not in _vocabulary.__dict__:
        v = bpe.Vocabulary(path)
        _vocabulary.__dict__[path] = v.encoder(), "<u2" if v.size <= 1 << 16 else "<u4"
    return _vocabulary.__dict__[path]


def encoded(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
            separator: int = SEPARATOR) -> DataFrame:
    """Pass 1, written to the shared folder: id, task, local_start, n, width and the ids (little-endian, 2 or 4 bytes)."""
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def encode(batches):
        from pyspark import TaskContext

        encoder, width = _vocabulary(path)
        task, start = TaskContext.get().partitionId(), 0
        for part in slices(batches, 1):
            ids, sizes = [], []
            for text in part.column(1).to_pylist():
                x = encoder.encode(text or "", allowed_special="all")
                x.append(separator)
                ids.append(np.array(x, width).tobytes())
                sizes.append(len(x))
            n = np.array(sizes, np.int64)
            at = start + np.cumsum(n) - n
            start += int(n.sum())
            yield [part.column(0), pa.array([task] * len(n), pa.int32()), pa.array(at), pa.array(n),
                   pa.array([int(width[-1])] * len(n), pa.int32()), pa.array(ids, pa.binary())]

    return written(arrow_map(rows, encode, f"`{id_column}` {kind}, task int, local_start long, n long, width int, ids binary"),
                   "encoded")


def placed(tokens: DataFrame) -> DataFrame:
    """The rows of pass 1 with ``first``, the global place of their first id.

    The totals are one row for each task of pass 1, so their running sum and their broadcast are bounded by the number
    of tasks, not by the data.
    """
    totals = tokens.groupBy("task").agg(F.sum("n").alias("total"))
    before = totals.select(F.col("task").alias("of"), (F.sum("total").over(W.orderBy("task")) - F.col("total")).alias("before"))
    return tokens.join(F.broadcast(before), F.col("task") == F.col("of")).withColumn(
        "first", F.col("before") + F.col("local_start")).drop("of", "before", "local_start", "task")


def pack(df: DataFrame, path: str, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
         separator: int = SEPARATOR, keep_ids: bool = True) -> DataFrame:
    """Pieces: id, start, length, doc_tokens, sequence_id, offset, crc32 of the ids as 32-bit words, and the ids as such."""
    kind = df.schema[id_column].dataType.simpleString()
    rows = placed(encoded(df, path, id_column, text_column, separator)).select(id_column, "n", "first", "width", "ids")

    def cut(batches):
        for part in slices_of_ids(batches):
            picked, starts, lengths, crcs, totals, places, ids = [], [], [], [], [], [], []
            for i, (n, first, width, raw) in enumerate(zip(*(part.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                words = np.frombuffer(raw, f"<u{width}").astype("<u4")
                edges = [0, *range(window - first % window, n, window), n]
                for a, b in zip(edges, edges[1:], strict=False):
                    piece = words[a:b].tobytes()
                    picked.append(i)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(piece))
                    totals.append(n)
                    places.append(first + a)
                    ids.append(piece if keep_ids else None)
            place = np.array(places, np.int64)
            yield [part.column(0).take(pa.array(picked, pa.int32())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                   pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()), pa.array(place // window),
                   pa.array(place % window), pa.array(ids, pa.binary())]

    return arrow_map(rows, cut, f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                "sequence_id long, `offset` long, piece binary")


def slices_of_ids(batches, most_bytes: int = 4 << 20):
    for batch in batches:
        a, size = 0, 0
        for i, n in enumerate(batch.column(1).to_pylist()):
            size += 4 * n
            if size >= most_bytes:
                yield batch.slice(a, i + 1 - a)
                a, size = i + 1, 0
        if a < batch.num_rows:
            yield batch.slice(a)


def sequences(pieces: DataFrame, window: int = WINDOW, padding: int = SEPARATOR, id_column: str = "doc_id") -> DataFrame:
    """Windows put together: sequence_id, ids, and the offsets and owners of the pieces in it.

    A group holds one window, at most ``window`` ids. A short last window is filled up with ``padding``, unless its
    length is a power of two.
    """
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct(
        "offset", "length", "piece", F.col(id_column).alias("owner")))).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    fill = F.when(F.bit_count(n) == 1, F.lit(0).cast("long")).otherwise(F.lit(window) - n)
    pad = F.unhex(F.repeat(F.lit(padding.to_bytes(4, "little").hex()), fill.cast("int")))
    joined = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["piece"]))
    return parts.select("sequence_id", F.concat(joined, pad).alias("ids"), n.alias("n_ids"),
                        F.transform("p", lambda x: x["offset"]).alias("offsets"),
                        F.transform("p", lambda x: x["owner"]).alias("owners"))
