"""Profiles of a ticket export: what is missing, how varied outcomes are, what a second descriptor adds.

Counts go through ``groupBy(key, value).count()`` first, so a value or key that owns most rows is combined on the
map side and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..fixed_values import DIVERSITY, SHARE_EDGES, SHARE_LABELS, WHITE_SPACE
from ..functions.numbers import cut_bins, round_half_even
from ..functions.ranking import exact_percentiles
from ..functions.text import strip

PAIR = ["complaint_type", "descriptor"]
TRIPLE = [*PAIR, "descriptor_2"]
RES = "resolution_description"


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_half_even(part / whole * 100, digits)


def resolved(df: DataFrame) -> DataFrame:
    return df.where(F.col(RES).isNotNull())


def usable_cases(df: DataFrame) -> DataFrame:
    """Closed with a recorded text other than N/A (only that one token counts as missing here)."""
    return df.where(_usable())


def _usable() -> Column:
    return ((F.col("status") == "Closed") & F.col(RES).isNotNull()
            & (F.upper(strip(F.col(RES))) != "N/A"))


def usable_share(df: DataFrame) -> DataFrame:
    n, u = F.count(F.lit(1)), F.count_if(_usable())
    return df.agg(n.alias("records"), u.alias("usable"), pct(u, n).alias("usable_pct"))


def _as_text(field: ST.StructField) -> Column:
    if isinstance(field.dataType, (ST.StructType, ST.ArrayType, ST.MapType)):
        return F.to_json(field.name)
    return F.col(field.name).cast("string")


def column_values(df: DataFrame) -> DataFrame:
    """(column, value, n) for all columns at once; nested values as JSON text."""
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column_name"), _as_text(f).alias("value")) for f in df.schema])
    return (df.select(F.explode(pairs).alias("p")).select("p.*")
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def column_counts(df: DataFrame, **counts: Callable[[Column], Column]) -> DataFrame:
    """(column_name, rows, the named aggregates): one plain aggregate over the table, no row is multiplied."""
    row = df.agg(F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.count(F.lit(1)).alias("rows"),
        *[fn(_as_text(f)).alias(name) for name, fn in counts.items()]) for f in df.schema]).alias("c"))
    return row.select(F.inline("c"))


def distinct_values(df: DataFrame, unique: tuple[str, ...] = ()) -> DataFrame:
    """(column_name, unique_values); of a column known to be unique only the filled rows are counted."""
    others = df.drop(*unique)
    counted = column_values(others).where(F.col("value").isNotNull()).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_values"))
    known = [c for c in unique if c in df.columns]
    if known:
        counted = counted.unionByName(column_counts(df.select(*known), unique_values=F.count).select("column_name", "unique_values"))
    return counted


def missing_profile(df: DataFrame, unique: tuple[str, ...] = ()) -> DataFrame:
    c = column_counts(df, missing_count=lambda x: F.count_if(x.isNull()))
    return c.join(distinct_values(df, unique), "column_name", "left").select(
        "column_name", "missing_count", pct(F.col("missing_count"), F.col("rows")).alias("missing_pct"),
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"))


def table_summary(df: DataFrame, unique: tuple[str, ...] = ()) -> DataFrame:
    """Per column: filled rows, type, distinct values, the most frequent value (ties: the smaller one) and its count.

    A column known to be unique needs no counting of values: each occurs once, and the smallest is the first.
    """
    types = F.create_map(*[x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    filled = column_values(df.drop(*unique)).where(F.col("value").isNotNull())
    # max_by needs one order: more rows first, then the smaller text. min over (-n, value) says exactly that.
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    got = filled.groupBy("column_name").agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct_values"),
                                            best.alias("b"))
    got = got.select("column_name", "filled", "distinct_values", F.col("b.value").alias("top_value"), (-F.col("b.neg")).alias("top_count"))
    known = [c for c in unique if c in df.columns]
    if known:
        once = column_counts(df.select(*known), filled=F.count, top_value=F.min).where("filled > 0")
        got = got.unionByName(once.select("column_name", "filled", F.col("filled").alias("distinct_values"), "top_value",
                                          F.lit(1).cast("bigint").alias("top_count")))
    return got.select("column_name", types[F.col("column_name")].alias("type"), "filled", "distinct_values", "top_value", "top_count")


def nested_type_audit(df: DataFrame) -> DataFrame:
    """Which columns hold records or lists, and in how many rows."""
    nested = [f for f in df.schema if isinstance(f.dataType, (ST.StructType, ST.MapType, ST.ArrayType))]
    parts = F.array(*[F.struct(F.lit(f.name).alias("column_name"),
                               F.lit(isinstance(f.dataType, ST.ArrayType)).alias("is_list"),
                               F.col(f.name).isNotNull().alias("filled")) for f in nested])
    return df.select(F.explode(parts).alias("p")).groupBy("p.column_name").agg(
        F.count_if(F.col("p.filled") & ~F.col("p.is_list")).alias("dictionaries"),
        F.count_if(F.col("p.filled") & F.col("p.is_list")).alias("lists"))


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Rows per value with its share of the non-null rows; nulls are not counted."""
    n = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = n.withColumn("__total", n.agg(F.sum("n")).scalar())
    out = total.withColumn("pct", pct(F.col("n"), F.col("__total"))).drop("__total")
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def crosstab_margins(df: DataFrame) -> DataFrame:
    """Status against missing outcome, with totals."""
    per = df.where(F.col("status").isNotNull()).rollup("status").agg(
        F.count_if(F.col(RES).isNotNull()).alias("available"), F.count_if(F.col(RES).isNull()).alias("missing"),
        F.count(F.lit(1)).alias("total"))
    return per.withColumn("status", F.coalesce("status", F.lit("All")))


def na_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    d = df.select(*cols)
    c = column_counts(d, missing=lambda x: F.count_if(x.isNull()),
                      na_text=lambda x: F.count_if(F.upper(F.btrim(x, F.lit(WHITE_SPACE))) == "N/A"))
    return c.join(distinct_values(d), "column_name", "left").select(
        "column_name", "missing", "na_text", F.coalesce("unique_values", F.lit(0)).alias("unique_values"))


def distinct_per_group(df: DataFrame, keys: list[str], value: str, name: str = "n_distinct",
                       approx: bool = False) -> DataFrame:
    """Distinct non-null values per group; groups with a null key are dropped."""
    d = df
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    agg = F.approx_count_distinct(value) if approx else F.countDistinct(value)
    return d.groupBy(*keys).agg(agg.alias(name))


def combo_stats(df: DataFrame) -> DataFrame:
    d = resolved(df).where(F.col("complaint_type").isNotNull() & F.col("descriptor").isNotNull())
    n = d.groupBy(*PAIR, RES).agg(F.count("unique_key").alias("n"))
    return n.groupBy(*PAIR).agg(F.sum("n").alias("total_cases"), F.count(F.lit(1)).alias("unique_resolutions"))


def with_all_labels(counts: DataFrame, labels: list[str], value_cols: list[str]) -> DataFrame:
    """Every label of a binned histogram, also the empty ones (as zero)."""
    spark = counts.sparkSession
    every = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("bucket"))
    out = every.join(counts, "bucket", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(counts.schema[c].dataType)) for c in value_cols})


def diversity_histogram(df: DataFrame) -> DataFrame:
    s = combo_stats(df).withColumn("bucket", cut_bins(F.col("unique_resolutions"), *DIVERSITY))
    n = with_all_labels(s.groupBy("bucket").agg(F.count(F.lit(1)).alias("combinations")), DIVERSITY[1], ["combinations"])
    total = F.sum("combinations").over(Window.partitionBy(F.lit(1)))
    return n.withColumn("pct", pct(F.col("combinations"), total))


def support_ratio(df: DataFrame, least: int = 5) -> DataFrame:
    d = resolved(df).where(F.col("complaint_type").isNotNull() & F.col("descriptor").isNotNull())
    n = d.groupBy(*PAIR, RES).agg(F.count(F.lit(1)).alias("n"))
    ok = F.count_if(F.col("n") >= least)
    return n.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("total_resolutions"), ok.alias("supported"),
                                (ok / F.count(F.lit(1))).alias("support_ratio"))


def duplicate_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, distinct rows and repeats for a set of columns; null counts as a value."""
    n = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("distinct_rows"),
                 (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"))


def topn_coverage(df: DataFrame, col: str = RES, tops: tuple = (5, 10, 20, 50, 100)) -> DataFrame:
    """Share of rows covered by the n most frequent values. Only the largest n values are ever ordered."""
    n = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n"))
    best = n.where(F.col(col).isNotNull()).orderBy(F.desc("n"), col).limit(max(tops))
    rn = best.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("n"), col)))
    rows = rn.select("rn", "n", F.explode(F.array(*[F.lit(t) for t in tops])).alias("top_n"))
    covered = F.sum(F.when(F.col("rn") <= F.col("top_n"), F.col("n")).otherwise(0))
    return (rows.groupBy("top_n").agg(covered.alias("cases"))
            .withColumn("__total", total.scalar())
            .withColumn("pct", pct(F.col("cases"), F.col("__total"))).drop("__total"))


def counts_by_month(df: DataFrame, time: Column) -> DataFrame:
    return (df.select(F.date_format(time, "yyyy-MM").alias("month")).where(F.col("month").isNotNull())
            .groupBy("month").agg(F.count(F.lit(1)).alias("n")))


def counts_by_day(df: DataFrame, time: Column) -> DataFrame:
    return (df.select(F.to_date(time).alias("day")).where(F.col("day").isNotNull())
            .groupBy("day").agg(F.count(F.lit(1)).alias("n")))


def descriptor2_gain(df: DataFrame) -> DataFrame:
    """Distinct representations without and with the second descriptor."""
    n = resolved(df).groupBy(*TRIPLE, RES).agg(F.count(F.lit(1)).alias("n"))
    base = n.groupBy(*PAIR, RES).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("fine"))
    s = base.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("base_unique"), F.sum("fine").alias("d2_unique"))
    more = F.col("d2_unique") - F.col("base_unique")
    return s.select("records", "base_unique", "d2_unique", (F.col("records") - F.col("base_unique")).alias("base_duplicates"),
                    (F.col("records") - F.col("d2_unique")).alias("d2_duplicates"), more.alias("additional"),
                    pct(more, F.col("base_unique")).alias("increase_pct"))


def histogram_of(counts: DataFrame, col: str) -> DataFrame:
    return counts.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n_groups"))


def descriptor2_variation(df: DataFrame) -> DataFrame:
    return distinct_per_group(resolved(df), PAIR, "descriptor_2", "unique_descriptor_2")


def resolution_variation(df: DataFrame, keys: list[str] = TRIPLE) -> DataFrame:
    return distinct_per_group(resolved(df), keys, RES, "unique_resolutions")


def diversity_before_after(df: DataFrame) -> DataFrame:
    parts = []
    for name, keys in (("without_descriptor_2", PAIR), ("with_descriptor_2", TRIPLE)):
        many = F.count_if(F.col("unique_resolutions") > 1)
        parts.append(resolution_variation(df, keys).agg(
            F.lit(name).alias("labels"), F.count(F.lit(1)).alias("n_groups"), many.alias("multiple"),
            pct(many, F.count(F.lit(1))).alias("multiple_pct")))
    return parts[0].unionByName(parts[1])


def field_coverage(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    d = resolved(df)
    aggs = [F.count(F.lit(1)).alias("total_cases"), F.count(col).alias("with_value"),
            (F.count(col) / F.count(F.lit(1)) * 100).alias("coverage_pct")]
    return d.where(F.col(by).isNotNull()).groupBy(by).agg(*aggs) if by else d.agg(*aggs)


def repeat_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Representations seen once and repeatedly, and the records in repeated ones; null counts as a value."""
    n = resolved(df).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    again = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return n.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("representations"),
                 F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("repeated"),
                 again.alias("records_in_repeated"), pct(again, F.sum("n")).alias("repeated_pct"))


def largest_groups(df: DataFrame, keys: list[str], top: int = 20) -> DataFrame:
    n = resolved(df).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), *keys).limit(top)


def input_patterns(df: DataFrame) -> DataFrame:
    """Label triples (groups with a null label dropped) with volume, diversity and top share."""
    d = resolved(df)
    for k in TRIPLE:
        d = d.where(F.col(k).isNotNull())
    n = d.groupBy(*TRIPLE, RES).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*TRIPLE).agg(F.sum("n").alias("total_cases"), F.count(F.lit(1)).alias("unique_resolutions"),
                                  (F.max("n") / F.sum("n")).alias("top1_share"))


def share_bucket() -> Column:
    return cut_bins(F.col("top1_share"), SHARE_EDGES, SHARE_LABELS, include_lowest=True)


def top1_share_hist(df: DataFrame) -> DataFrame:
    p = input_patterns(df).withColumn("bucket", share_bucket())
    n = p.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("patterns"), F.sum("total_cases").alias("volume"),
        F.count_if(F.col("unique_resolutions") >= 2).alias("with_2_or_more"),
        F.count_if(F.col("unique_resolutions") >= 3).alias("with_3_or_more"))
    n = with_all_labels(n, SHARE_LABELS, ["patterns", "volume", "with_2_or_more", "with_3_or_more"])
    return n.withColumn("volume_pct", F.col("volume") / F.sum("volume").over(Window.partitionBy(F.lit(1))) * 100)


def bucket_describe(df: DataFrame) -> DataFrame:
    p = input_patterns(df).withColumn("bucket", share_bucket()).where(F.col("bucket").isNotNull())
    q = exact_percentiles(p, ["bucket"], "total_cases", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, width=100.0)
    m = p.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("total_cases").alias("mean"), F.stddev_samp("total_cases").alias("std"),
        F.min("total_cases").alias("min"), F.max("total_cases").alias("max"))
    return m.join(q, "bucket")


def group_percentages(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each outcome within its group. The group totals come from the counts, not from the rows."""
    d = df
    for k in [*keys, RES]:
        d = d.where(F.col(k).isNotNull())
    n = d.groupBy(*keys, RES).agg(F.count(F.lit(1)).alias("n"))
    totals = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    return n.join(totals, keys).select(*keys, RES, "n", pct(F.col("n"), F.col("total")).alias("pct"))


def group_share(df: DataFrame, keys: list[str], value: str, out: str = "share") -> DataFrame:
    """Each row's value over the total of its group."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    return df.join(totals, keys).withColumn(out, F.col(value) / F.col("__total")).drop("__total")


def resolution_time_stats(df: DataFrame, hours: str) -> DataFrame:
    d = df.where(F.col(RES).isNotNull() & F.col(hours).isNotNull())
    q = exact_percentiles(d, [RES], hours, {"median": 0.5})
    m = d.groupBy(RES).agg(F.count(F.lit(1)).alias("n"), F.avg(hours).alias("mean"), F.min(hours).alias("min"),
                           F.max(hours).alias("max"))
    return m.join(q, RES)


def descriptor_listing(df: DataFrame) -> DataFrame:
    """Every (type, descriptor) with its rows and distinct outcomes; a list per type would not be bounded."""
    d = df.where(F.col("complaint_type").isNotNull() & F.col("descriptor").isNotNull())
    n = d.groupBy(*PAIR, RES).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*PAIR).agg(F.sum("n").alias("n"), F.count(RES).alias("n_resolutions"))


def date_range(df: DataFrame, time: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records"), F.min(time).alias("oldest"), F.max(time).alias("latest"),
                  F.count_if(time.isNull()).alias("unparseable"))


def ingest_data_audit(raw: DataFrame) -> DataFrame:
    """Rows with signs of double encoding, and repeated keys inside the batch."""
    marks = F.coalesce(F.col(RES), F.lit("")).rlike("â|Ã")
    per_key = raw.groupBy("unique_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(marks).alias("m"))
    return per_key.agg(F.sum("n").alias("records"), F.sum("m").alias("double_encoded"),
                       (F.sum("n") - F.count(F.lit(1))).alias("duplicate_keys"))
