"""Rounding on the exact binary value and number formatting, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V

_SPLIT = 134217729.0  # 2**27 + 1: splits a double into two halves whose small products are exact


def let(x: Column, fn) -> Column:
    """``fn(x)`` with ``x`` computed once per row, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Round a double to ``digits`` places by its exact binary value, ties to even.

    ``round`` and ``bround`` work on the shortest decimal text of the value, so 0.35 counts as a tie
    although the stored double lies below it. Here the distance to the tie is computed without error:
    the high half times the scale is exact, and so is its difference to the nearby tie.
    """
    scale = float(10**digits)

    def rounded(v: Column) -> Column:
        a = F.abs(v)
        c = a * _SPLIT
        hi = c - (c - a)
        k = F.floor(a * scale)
        to_tie = (hi * (2 * scale) - (k * 2 + 1)) + (a - hi) * (2 * scale)
        up = (to_tie > 0) | ((to_tie == 0) & (k % 2 == 1))
        out = (k + F.when(up, 1).otherwise(0)) / F.lit(scale)
        return F.when(F.isnan(v), v).when(v < 0, -out).otherwise(out)

    return let(x.cast("double"), rounded)


def percent_text(share: Column) -> Column:
    """``0.125`` -> ``12%``."""
    return F.concat(round_half_even(share * 100).cast("bigint").cast("string"), F.lit("%"))


def fixed_places(x: Column, digits: int) -> Column:
    """A number with exactly ``digits`` decimals, such as ``0.731``."""
    scale = 10**digits

    def text(whole: Column) -> Column:
        return F.concat(F.floor(whole / scale).cast("string"), F.lit("."), F.lpad((whole % scale).cast("string"), digits, "0"))

    whole = F.round(F.abs(round_half_even(x, digits)) * scale).cast("bigint")
    return F.concat(F.when(x < 0, "-").otherwise(""), let(whole, text))


def format_duration(hours: Column) -> Column:
    """Hours with one decimal; from 48 hours on the rounded days are added. Missing hours have a fixed text."""

    def text(h: Column) -> Column:
        short = F.concat(fixed_places(h, 1), F.lit(" hours"))
        days = round_half_even(h / 24).cast("bigint").cast("string")
        return F.when(h >= 48, F.concat(short, F.lit(" (about "), days, F.lit(" days)"))).otherwise(short)

    return F.coalesce(let(hours, text), F.lit(V.NO_DURATION))


def support_bucket(n: Column, buckets) -> Column:
    out = None
    for name, low in buckets[:-1]:
        out = F.when(n >= low, name) if out is None else out.when(n >= low, name)
    return out.otherwise(buckets[-1][0])


def cut_bins(x: Column, edges: list, labels: list[str], include_lowest: bool = False) -> Column:
    """Right-closed intervals ``(edges[i], edges[i+1]]``; outside or null -> null."""
    out = None
    for i, label in enumerate(labels):
        low = (x >= edges[i]) if (include_lowest and i == 0) else (x > edges[i])
        high = F.lit(True) if edges[i + 1] is None else (x <= edges[i + 1])
        out = F.when(low & high, label) if out is None else out.when(low & high, label)
    return out
