"""Running totals, ranks, exact percentiles and first-n that hold up when one key owns most rows.

A plain window puts a whole key into one task. The helpers here split every key into buckets along the
sort order: totals per bucket come from a partially aggregated ``groupBy``, only those few totals are
accumulated per key, and the rows themselves are ordered inside their bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left copy of the keys."""
    if not keys:
        raise ValueError("join_on needs keys")
    names = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(names)
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[n]) for k, n in names.items()])
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


FINER = 4096
MOST_VALUES = 100_000


def running_total(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
                  weights: dict[str, str]) -> DataFrame:
    """Add for each ``out: column`` of ``weights`` the sum over all rows that sort before this one.

    ``bucket`` must grow (weakly) with ``order``. Rows should be distinct in ``order``.
    """
    b = df.withColumn("__bucket", bucket)
    per_bucket = b.groupBy(*keys, "__bucket").agg(
        *[F.sum(c).alias(f"__sum_{o}") for o, c in weights.items()])
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "__bucket",
        *[F.coalesce(F.sum(f"__sum_{o}").over(before), F.lit(0)).alias(f"__off_{o}") for o in weights])
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = join_on(b, offsets, [*keys, "__bucket"])
    for o, c in weights.items():
        out = out.withColumn(o, F.col(f"__off_{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("__bucket", *[f"__off_{o}" for o in weights])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      width: float = 1.0) -> DataFrame:
    """Linear-interpolated percentiles per key, exact, nulls skipped; one row per key that has a value.

    Equal values are counted first. A histogram of step ``width`` tells which buckets hold the wanted
    ranks, and only the rows of those buckets are put in order.
    """
    freq = (df.where(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).cast("double").alias("__v"))
            .agg(F.count(F.lit(1)).alias("__n")))
    return percentiles_of_counts(freq, keys, "__v", "__n", probs, width)


def percentiles_of_counts(freq: DataFrame, keys: list[str], value: str, count: str, probs: dict[str, float], width: float = 1.0,
                          most_values: int = MOST_VALUES) -> DataFrame:
    """The same from ``(keys, value, count)`` rows that hold each value once per key.

    Selection by refinement: a histogram of step ``width`` finds the buckets that hold a wanted rank. While some such bucket
    has more than ``most_values`` distinct values, its own range is split into ``FINER`` parts and the parts that hold a
    wanted rank take its place, so that what has to be put in order stays small whatever the spread of the values. The
    counts are written once; each pass reads only the values of the buckets before it.
    """
    def rank(p: float) -> Column:
        return (F.col("__total") - 1) * F.lit(float(p))

    def within(r: Column, start: Column, n: Column) -> Column:
        return (r >= start) & (r < start + n)

    ranks = [f(rank(p)) for p in probs.values() for f in (F.floor, F.ceil)]
    wanted = reduce(lambda a, b: a | b, [within(r, F.col("__from"), F.col("__bn")) for r in ranks])
    tally = [F.sum("__n").alias("__bn"), F.count(F.lit(1)).alias("__d")]

    freq = freq.select(*keys, F.col(value).cast("double").alias("__v"), F.col(count).alias("__n"),
                       F.array(F.floor(F.col(value) / F.lit(float(width))).cast("long")).alias("__b")).where(F.col("__v").isNotNull())
    rows = materialise(freq, "values")
    run = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    hist = rows.groupBy(*keys, "__b").agg(*tally).withColumns({
        "__from": F.coalesce(F.sum("__bn").over(run), F.lit(0)), "__total": F.sum("__bn").over(Window.partitionBy(*keys))})
    picked = materialise(hist.where(wanted), "buckets")
    rows = join_on(rows, picked.drop("__bn"), [*keys, "__b"])
    while (picked.agg(F.max("__d")).first()[0] or 0) > most_values:
        rows = materialise(rows, "values")
        ends = rows.groupBy(*keys, "__b").agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        place = F.floor((F.col("__v") / 2 - F.col("__low") / 2) / (F.col("__high") / 2 - F.col("__low") / 2) * (FINER - 1))
        split = join_on(rows, ends, [*keys, "__b"]).withColumn(
            "__part", F.when(F.col("__d") <= most_values, F.lit(0)).otherwise(place).cast("long"))
        inner = Window.partitionBy(*keys, "__b").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        hist = split.groupBy(*keys, "__b", "__part").agg(*tally, F.max("__from").alias("__from"), F.max("__total").alias("__total"))
        hist = hist.withColumn("__from", F.col("__from") + F.coalesce(F.sum("__bn").over(inner), F.lit(0)))
        picked = materialise(hist.where(wanted).withColumn("__b", F.array_append("__b", F.col("__part"))), "buckets")
        split = split.select(*keys, "__v", "__n", F.array_append("__b", F.col("__part")).alias("__b"))
        rows = join_on(split, picked.drop("__bn", "__part"), [*keys, "__b"])
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__start", F.col("__from") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    aggs = []
    for name, p in probs.items():
        for part, r in (("lo", F.floor(rank(p))), ("hi", F.ceil(rank(p)))):
            aggs.append(F.max(F.when(within(r, F.col("__start"), F.col("__n")), F.col("__v")))
                        .alias(f"__{part}_{name}"))
    ends = rows.groupBy(*keys).agg(F.max("__total").alias("__total"), *aggs)
    return ends.select(*keys, *[
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * (rank(p) - F.floor(rank(p)))).alias(n)
        for n, p in probs.items()])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark cuts every key to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_n(df: DataFrame, n: int, order: list[Column], levels: list[Column]) -> DataFrame:
    """``orderBy(order).limit(n)`` without pulling ``n`` rows from every task into one, and without carrying the other columns.

    ``levels`` are ever finer buckets along the sort order (say day, then second). Only they are computed for all rows, and
    written. At each level a histogram of the bucket in question finds the next one, where the n-th row falls. The rows
    themselves are then read once, up to that bucket; whatever stands behind ``df`` - joins, say - runs for them alone.
    """
    names = [f"level{i}" for i in range(len(levels))]
    kept = materialise(df.select(*[c.alias(x) for c, x in zip(levels, names, strict=True)]), "levels")
    left, wanted, here = n, F.lit(False), F.lit(True)
    for level, name in zip(levels, names, strict=True):
        hist = kept.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        run = Window.orderBy(F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        upto = hist.select(name, F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before")).where(F.col("before") < left)
        last = upto.orderBy(F.desc("before")).first()
        if last is None:
            return df.orderBy(*order).limit(n)  # no rows, or none wanted
        at = F.lit(last[name])
        if last[name] is not None:
            wanted = wanted | (here & (level.isNull() | (level < at)))
        here = here & level.eqNullSafe(at)
        left -= last["before"]
        kept = kept.where(F.col(name).eqNullSafe(at))
    return df.where(wanted | here).orderBy(*order).limit(n)


def outcome_ranks(outcomes: DataFrame) -> DataFrame:
    """Position of each outcome within its pattern: most frequent first, ties by id.

    Ids are uniform hex, so (count, first three digits) splits even a pattern with a huge tail of rare outcomes.
    """
    b = outcomes.withColumn("__p", F.substring("resolution_id", 1, 3))
    sizes = b.groupBy("pattern_id", "count", "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy("pattern_id").orderBy(F.desc("count"), "__p")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("pattern_id", "count", "__p",
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("pattern_id", "count", "__p").orderBy("resolution_id")
    return (b.join(offsets, ["pattern_id", "count", "__p"])
            .withColumn("rank", (F.col("__off") + F.row_number().over(inside)).cast("bigint"))
            .drop("__p", "__off"))
