"""Views that give the driver tables the shape of a ticket history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.embed import l2_normalise

CUTOFF = "2000-07-01 00:00:00"
OUT_OF_DOMAIN = 9
NOISE = 0.45
SHIP_VECTORS = 2_000_000  # (vec_id, label) rows that go to every executor


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is one task (one small or unsplittable file) dealt out to the cores; anything larger stays as it is."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else df


def tickets_raw(spark: SparkSession, sf: str) -> DataFrame:
    """All-string tickets out of lineitem x orders x part."""
    li = spread(table(spark, sf, "lineitem"))
    o = table(spark, sf, "orders")
    p = table(spark, sf, "part")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    late = F.col("o_orderdate") >= F.lit("2000-10-01 00:00:00").cast("timestamp_ntz")
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unique_key"),
        F.col("o_orderdate").cast("string").alias("created_date"),
        F.when((F.col("l_discount") == 0.05) & (F.col("l_tax") == 0.03) | (F.col("p_size") == 50) & (F.col("p_partkey") % 3 == 0),
               "pending")
        .otherwise(F.col("l_shipdate").cast("string")).alias("closed_date"),
        F.when(late & (F.col("p_size") == 1), "NEWTYPE").otherwise(F.col("p_type")).alias("complaint_type"),
        F.when(F.col("p_size") == 50, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.col("p_brand"))
        .alias("descriptor"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " N/A ").otherwise(F.col("o_orderpriority"))
        .alias("descriptor_2"),
        F.when(F.col("o_orderstatus") == "P", "Open").otherwise("Closed").alias("status"),
        F.when((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0), "n/a")
        .when((F.col("p_type") == "PROMO") & ((F.col("l_linenumber") != 1) | (F.col("l_quantity") > 20)),
              "Returned in full.")
        .when((F.col("p_type") == "ECONOMY") & (F.col("l_linenumber") > 3), "Refunded. No further action.")
        .when(late & (F.col("l_linenumber") == 7), "Escalated.")
        .otherwise(F.concat(F.lit("Recorded as "), "l_returnflag", "l_linestatus", F.lit(".")))
        .alias("resolution_description"),
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.concat("l_returnflag", "l_linestatus")).alias("borough"),
        F.concat(F.lit("Agency "), F.substring("o_orderpriority", 1, 1)).alias("agency"),
    )


def tickets_export(spark: SparkSession, sf: str) -> DataFrame:
    """The same tickets the way a full export looks after reading: nulls, padded "N/A", 10 columns."""
    raw = tickets_raw(spark, sf)
    return raw.select(
        "unique_key", "created_date", "closed_date", "agency", "complaint_type", "descriptor",
        F.when(F.trim("descriptor_2") == "N/A", None).otherwise(F.col("descriptor_2")).alias("descriptor_2"),
        "borough", "status",
        F.when(F.col("resolution_description") == "n/a", None)
        .when(F.col("resolution_description") == "Escalated.", " N/A ")
        .otherwise(F.col("resolution_description")).alias("resolution_description"),
    )


def indexed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding with the labels of its ticket class; classes outside the history stay in as queries only."""
    e = table(spark, sf, "embeddings")
    return _class_labels(e.select(
        "vec_id", "label", (F.col("vec_id") % 16).cast("int").alias("slot"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))


def _class_labels(e: DataFrame) -> DataFrame:
    """The labels of the ticket class that ``vec_id`` and ``label`` name, and their pattern."""
    return e.withColumns({
        "complaint_type": F.concat(F.lit("CLASS "), F.col("label").cast("string")),
        "descriptor": F.concat(F.lit("Block "), F.floor(F.col("vec_id") / 16).cast("string")), "descriptor_2": F.lit(""),
    }).withColumn("pattern_id", T.identity_hash(F.col("complaint_type"), F.col("descriptor"), F.col("descriptor_2")))


def _gold() -> list[Column]:
    inside = F.col("label") != OUT_OF_DOMAIN
    return [inside.alias("in_domain"), F.when(inside, F.col("pattern_id")).alias("gold_pattern"),
            F.when(inside, F.col("complaint_type")).alias("gold_type")]


def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.vectors import pack_vector_id

    e = indexed_embeddings(spark, sf).where(F.col("label") != OUT_OF_DOMAIN)
    return e.select(pack_vector_id(F.col("pattern_id"), F.col("slot")).alias("vec_id"), "pattern_id", "slot", "embedding")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding, blurred with its own mirror image, asks for the pattern it came from."""
    e = indexed_embeddings(spark, sf)
    blurred = F.zip_with("embedding", F.reverse("embedding"), lambda a, b: a * NOISE + b)
    return e.select(F.col("vec_id").alias("query_id"), *_gold(), l2_normalise(blurred).alias("embedding"))


def vector_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Raw tickets of all parts: part number modulo the number of vectors names the vector whose class a ticket has.

    A vector outside the domain lends its number's class instead. The tickets of every ninth block are closed at times
    nobody can read.
    """
    vectors = table(spark, sf, "embeddings")
    n = vectors.count()
    label = F.when(F.col("label") == OUT_OF_DOMAIN, (F.col("vec_id") % OUT_OF_DOMAIN).cast("int")).otherwise(F.col("label"))
    e = vectors.select("vec_id", label.alias("label"))
    li = spread(table(spark, sf, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus",
        (F.col("l_partkey") % n if n else F.lit(None).cast("long")).alias("vec"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    # Two numbers a vector: shipped up to the limit, whatever the size of the file they are read from; texts are made after the joins.
    j = li.join(F.broadcast(e) if n <= SHIP_VECTORS else e, li.vec == e.vec_id).join(o, li.l_orderkey == o.o_orderkey)
    j = j.withColumns({
        "complaint_type": F.concat(F.lit("CLASS "), F.col("label").cast("string")),
        "descriptor": F.concat(F.lit("Block "), F.floor(F.col("vec_id") / 16).cast("string")), "descriptor_2": F.lit("")})
    kind = F.col("label") % 3
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unique_key"),
        F.col("o_orderdate").cast("string").alias("created_date"),
        F.when(F.floor(F.col("vec_id") / 16) % 9 == 2, "pending").otherwise(F.col("l_shipdate").cast("string")).alias("closed_date"),
        "complaint_type", "descriptor", "descriptor_2",
        F.when((kind == 0) & (F.col("l_quantity") <= 48),
               "Returned in full. The unit was checked on arrival and found complete.")
        .when((kind == 1) & (F.col("l_quantity") <= 28), "Refunded. No further action.")
        .otherwise(F.concat(F.lit("Recorded as "), "l_returnflag", "l_linestatus", F.lit(" in step "),
                            F.col("l_linenumber").cast("string"), F.lit(". The case was closed after review! See note.")))
        .alias("resolution_description"))


def complaints(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a complaint; its number modulo the number of vectors names the vector query it asks with."""
    return (_documents_by_vector(spark, sf).join(vector_queries(spark, sf).withColumnRenamed("query_id", "vec_id"), "vec_id")
            .drop("vec_id").withColumn("complaint", T.collapse(F.coalesce("complaint", F.lit("")))))


def complaint_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows without their vectors. Two numbers a vector are shipped, up to the limit, so no text moves for them."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    j = _documents_by_vector(spark, sf).join(F.broadcast(e) if e.count() <= SHIP_VECTORS else e, "vec_id")
    return _class_labels(j).select("query_id", T.collapse(F.coalesce("complaint", F.lit(""))).alias("complaint"), *_gold())


def _documents_by_vector(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("complaint"), (F.col("doc_id") % n).alias("vec_id"))


def document_selections(spark: SparkSession, sf: str) -> DataFrame:
    """The outside picks for the complaints: those of the vector each one asks with."""
    picks = selections(spark, sf).withColumnRenamed("query_id", "vec_id")
    return _documents_by_vector(spark, sf).drop("complaint").join(picks, "vec_id").drop("vec_id")


def selections(spark: SparkSession, sf: str) -> DataFrame:
    """Outside picks: one row per vector query, 0 = no candidate fits, null = the outside step gave no answer."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("query_id"),
        F.nullif((F.floor(F.col("vec_id") / 3) % 8).cast("int"), F.lit(7)).alias("selected_candidate"),
        F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high")]), (F.col("vec_id") % 3 + 1).cast("int"))
        .alias("confidence"),
        (F.col("vec_id") % 5 + 1).cast("int").alias("severity"),
        F.when(F.col("vec_id") % 2 == 0, "angry").otherwise("frustrated").alias("sentiment"))


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Two drafted answers per document: its lines are the opening, the summary and the steps.

    The second attempt spells out every number, so it breaks fewer rules than the first.
    """
    # dealt out by complaint, as whoever checks them needs them, while a text is there once and not once per attempt
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text").repartition("query_id")
    d = d.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    body = F.when(F.col("attempt") == 1, F.col("text")).otherwise(F.regexp_replace("text", "[0-9]", "n"))
    d = d.withColumn("lines", F.split(body, "\n"))

    def cites(i):
        return (F.when(i % 4 == 0, F.array(F.lit("P1"))).when(i % 4 == 1, F.array(F.lit("[P1]"), F.lit("R1")))
                .when(i % 4 == 2, F.when(F.col("attempt") == 1, F.array().cast("array<string>"))
                      .otherwise(F.array(F.lit(" R1 "))))
                .otherwise(F.array(F.lit("R1"), F.lit("R99"))))

    items = F.transform("lines", lambda t, i: F.struct(t.alias("text"), cites(i).alias("citations")))
    return d.select(
        "query_id", "attempt",
        F.substring_index(F.element_at("lines", 1), ".", 1).alias("opening"),
        F.element_at(items, 1).alias("summary"),
        F.slice(items, F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))).alias("steps"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Judged claims; some claims got no verdict."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return c.select(
        F.col("conv_id").alias("query_id"), ((F.col("turn") + 1) / 2).cast("int").alias("id"),
        F.when(F.length("text") % 3 == 0, "partial").otherwise("supported").alias("verdict"),
        F.lit("checked against the sources").alias("reason"))


def answer_log(spark: SparkSession, sf: str) -> DataFrame:
    return log_of_events(table(spark, sf, "events"))


def timings(spark: SparkSession, sf: str) -> DataFrame:
    """Milliseconds per stage of each complaint, made from its number; every fifth has no parse stage, the next no generate stage."""
    q = F.col("query_id")
    total = ((q * 37) % 5000 + 500).cast("double")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("query_id")).select("query_id", F.create_map(
        F.lit("total"), total, F.lit("retrieve"), total / 4, F.lit("parse"), F.when(q % 5 != 0, total / 8),
        F.lit("generate"), F.when(q % 5 != 1, total / 2)).alias("stage_ms"))


def log_of_events(ev: DataFrame) -> DataFrame:
    """One answered or abstained request per event; works on a stream as well."""
    t = F.col("event_type")
    return ev.select(
        "event_id", "ts",
        (t == "error").alias("abstained"),
        F.when(t == "error", "low_similarity (top cosine)").otherwise("none").alias("reason"),
        F.when(t == "purchase", "fast_lookup").when(t == "click", "rag_light").otherwise("rag_core").alias("tier"),
        F.when(t == "signup", "template_degraded").when(t == "purchase", "template").otherwise("llm").alias("method"),
        (F.col("event_id") % 5 + 1).cast("int").alias("severity"),
        (((F.col("event_id") * 37) % 500).cast("double") / 1000 + 0.5).alias("top_score"),
        (F.col("value") * 100).alias("total_ms"),
        F.create_map(F.lit("total"), F.col("value") * 100, F.lit("retrieve"), F.col("value") * 25, F.lit("parse"),
                     F.when(t != "purchase", F.col("value") * 15), F.lit("generate"),
                     F.when(t != "error", F.col("value") * 60)).alias("stage_ms"),
        (F.col("event_id") % 3).cast("int").alias("first_attempt_violations"),
        (F.length("props") + F.col("event_id") % 50).alias("prompt_tokens"),
        (F.col("event_id") % 20).alias("completion_tokens"))
