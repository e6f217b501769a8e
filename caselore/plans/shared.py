"""Tables that many queries read, written once per session to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_path

_STORED: dict[tuple[str, str, str], tuple[str, object]] = {}


def forget() -> None:
    """Build every shared table anew from now on, for instance after the data under a path has changed."""
    _STORED.clear()


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` for the data under ``sf``; built on first use, then read with pruned columns."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        df = build()
        path = fresh_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)
