"""From raw tickets to clean tickets: repair, filter, dates, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as T

_TEXT = [*V.LABELS, "resolution_description"]


def repair_text(raw: DataFrame) -> DataFrame:
    """Null -> empty, double encoding repaired, white space stripped, missing second descriptor blanked."""
    out = raw.withColumns({c: T.strip(T.fix_mojibake(F.coalesce(F.col(c), F.lit("")))) for c in _TEXT})
    return out.withColumn("descriptor_2", T.blank_missing(F.col("descriptor_2")))


def is_closed(df: DataFrame) -> Column:
    """Open tickets are dropped only where a status is recorded at all."""
    return F.coalesce(F.col("status") == "Closed", F.lit(False)) if "status" in df.columns else F.lit(True)


def has_resolution() -> Column:
    return ~T.is_missing(F.col("resolution_description"))


def has_labels() -> Column:
    return (F.col("complaint_type") != "") & (F.col("descriptor") != "")


def to_time(c: Column) -> Column:
    """Unreadable times become null."""
    return c.try_cast("timestamp_ntz")


def close_hours(created: Column, closed: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", created, closed) / F.lit(3.6e9)


def flagged(raw: DataFrame) -> DataFrame:
    """Repaired rows with the filters they pass (``closed``, ``resolved``, ``usable``, each implying the one before)."""
    t = repair_text(raw)
    closed = is_closed(t)
    resolved = closed & has_resolution()
    return t.withColumns({"closed": closed, "resolved": resolved, "usable": resolved & has_labels()})


def usable_tickets(t: DataFrame) -> DataFrame:
    """The clean tickets out of flagged rows."""
    t = t.where("usable").withColumns({"created_date": to_time(F.col("created_date")), "closed_date": to_time(F.col("closed_date"))})
    return t.select(
        "unique_key", "created_date", "closed_date", *V.LABELS, "resolution_description",
        close_hours(F.col("created_date"), F.col("closed_date")).alias("close_hours"),
        T.identity_hash(*[F.col(c) for c in V.LABELS]).alias("pattern_id"),
        T.identity_hash(F.col("resolution_description")).alias("resolution_id"),
    )


def clean_tickets(raw: DataFrame) -> DataFrame:
    """One narrow projection chain; no shuffle."""
    return usable_tickets(flagged(raw))


def count_flags(t: DataFrame) -> DataFrame:
    return t.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if("closed").alias("closed"),
                 F.count_if("resolved").alias("with_resolution"), F.count_if("usable").alias("usable"))


def clean_funnel(raw: DataFrame) -> DataFrame:
    """Rows left after each filter, counted in one pass."""
    return count_flags(flagged(raw))
