"""Reading tickets, complaints and examples; the contract a batch must meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import fixed_values as V
from ..functions.ranking import first_n
from ..functions.text import strip


def null_tokens(df: DataFrame, tokens=None, cols=None) -> DataFrame:
    """Exact spellings of "missing" become null; padded or other-case spellings stay."""
    tokens = V.CSV_NA_TOKENS if tokens is None else tokens
    return df.withColumns({c: F.when(~F.col(c).isin(tokens), F.col(c)) for c in (cols or df.columns)})


def read_tickets_csv(spark: SparkSession, path: str, columns: list[str] | None = None, na_tokens=None,
                     multi_line: bool = False) -> DataFrame:
    """All columns as text, never inferred. Without ``columns`` the header row names them, with it they must agree.

    Large files are split at line ends. Texts with quoted line breaks need ``multi_line``, which reads each file as a
    whole. Short rows are filled with nulls.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("enforceSchema", False).option("escape", '"').option(
        "mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if columns:
        reader = reader.schema(ST.StructType([ST.StructField(c, ST.StringType()) for c in columns]))
    return null_tokens(reader.csv(path), na_tokens)


def closed_between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Closed, with a recorded outcome, created in [start, end); the seven columns the engine needs.

    Plain comparisons on the source columns, so that a columnar or JDBC source can evaluate them itself.
    """
    return df.where((F.col("status") == "Closed") & F.col("resolution_description").isNotNull()
                    & (F.col("created_date") >= start) & (F.col("created_date") < end)).select(*V.REQUIRED)


def created_from(df: DataFrame, start: str) -> DataFrame:
    return df.where(F.col("created_date") >= start)


def oldest_first(df: DataFrame, limit: int | None, time: str = "created_date", tie: str = "unique_key") -> DataFrame:
    """In order of creation, optionally only the first ``limit`` (a download cap)."""
    if limit is None:
        return df.orderBy(time, tie)
    day = F.substring(F.col(time).cast("string"), 1, 10)
    return first_n(df, limit, [F.col(time), F.col(tie)], [day, F.col(time).cast("string")])


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in V.REQUIRED if c not in df.columns]


def check_columns(df: DataFrame) -> int:
    """The number of columns beyond the required ones; raises ``ValueError`` if one of those is missing."""
    missing = missing_columns(df)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return len(set(df.columns) - set(V.REQUIRED))


def check_size(n: int, max_rows: int | None = V.MAX_BATCH) -> None:
    if n < 1:
        raise ValueError("a batch must not be empty")
    if max_rows is not None and n > max_rows:
        raise ValueError(f"a batch must have 1 to {max_rows} rows")


def check_contract(df: DataFrame, max_rows: int | None = V.MAX_BATCH) -> dict:
    """Required columns present and 1..max_rows rows (None: any number); raises ``ValueError`` otherwise."""
    extra = check_columns(df)
    check_size(df.limit((max_rows or 0) + 1).count(), max_rows)
    return {"missing": [], "extra_columns": extra}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One query per line, blank lines dropped."""
    return spark.read.text(path).where(F.length(strip(F.col("value"))) > 0)


EXAMPLE_SCHEMA = "pattern_id string, complaints array<string>"


def read_examples(spark: SparkSession, path: str, patterns: DataFrame | None = None) -> DataFrame:
    """Example complaints per pattern; only of known patterns if ``patterns`` is given."""
    ex = spark.read.schema(EXAMPLE_SCHEMA).json(path)
    return ex if patterns is None else ex.join(patterns.select("pattern_id"), "pattern_id", "left_semi")


def resume_todo(items: DataFrame, done: DataFrame, key: str, limit: int | None = None,
                order: list[Column] | None = None) -> DataFrame:
    """What an earlier run has not produced yet. A limit counts before finished work is taken out."""
    if limit:
        items = items.orderBy(*(order or [F.col(key)])).limit(limit)
    return items.join(done.select(key), key, "left_anti")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).mode("overwrite").csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
