"""Helpers shared by the operators of this folder: tables, written stages, UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: survives lost executors, and its rows are fixed from now on."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), starts


def slices(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with a bounded amount of text in column ``text``; a longer text is a part of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, starts = utf8(batch.column(text))
        a = 0
        while a < n:
            b = int(np.searchsorted(starts, starts[a] + most_bytes, side="right")) - 1
            b = min(max(b, a + 1), n)
            yield batch.slice(a, b - a)
            a = b


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores behind it until none of the tables has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def arrow_map(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """``fn(batches)`` yields lists of columns in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kinds)

    def run(batches):
        for columns in fn(batches):
            arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == f.type
                      else c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                      for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # functions go by place, so any names will do
    return named.mapInArrow(run, kinds)
