"""Preference formatting: the turns both conversations of a pair begin with are rendered once, then both continuations.

Everything is built-in expressions. The common prefix is found without putting a conversation together: turns are
counted per (pair, turn number, role, text) on both sides, and the first turn number whose counts differ ends the
prefix. A conversation of any length is therefore only ever a set of rows.

Defined results: a null role or text is empty; a null turn number stands behind all others; a null pair id is a pair of
its own; turns repeated under one number are compared as a bag and ordered by role and text; equal conversations give
a prompt and no completion; if one conversation is the beginning of the other its completion is empty; other columns
are not read. ``pairs`` gives a row for each pair (several for one too long for a row), with the spans to be trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAST = (1 << 63) - 1
BLOCK_BITS = 8
ROW_CHARS = 1 << 20


def turns(df: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    return df.select(F.col(pair).alias("pair_id"), F.coalesce(F.col(turn).cast("long"), F.lit(LAST)).alias("turn"),
                     F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def segments(chosen: DataFrame, rejected: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each rendered turn: pair_id, part (prompt, chosen or rejected), turn, role, rendered, loss.

    ``chosen`` and ``rejected`` have pair_id, turn, role, text. ``loss`` marks the turns a model is trained on: those of
    a trained role in a completion, never the prompt. Order by turn, role, rendered gives the text of a part.
    """
    both = turns(chosen).withColumn("side", F.lit("chosen")).unionByName(turns(rejected).withColumn("side", F.lit("rejected")))
    one = F.when(F.col("side") == "chosen", 1).otherwise(-1)
    counted = both.groupBy("pair_id", "turn", "role", F.md5("text").alias("digest")).agg(F.sum(one).alias("more"))
    ends = counted.groupBy("pair_id").agg(F.min(F.when(F.col("more") != 0, F.col("turn"))).alias("end"))
    ends = ends.select(F.col("pair_id").alias("of"), "end")
    joined = both.join(ends, F.col("pair_id").eqNullSafe(F.col("of")), "left")
    common = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    part = F.when(common, "prompt").otherwise(F.col("side"))
    return joined.where(~common | (F.col("side") == "chosen")).select(
        "pair_id", part.alias("part"), "turn", "role",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n")).alias("rendered"),
        (~common & F.col("role").isin(*trained)).alias("loss"))


def examples(parts: DataFrame) -> DataFrame:
    """One row for each pair: prompt, chosen, rejected, and the character spans [from, to) with a loss in both.

    For conversations that fit a row, as a training example must; ``segments`` has no such bound.
    """
    out = parts.groupBy("pair_id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("part") == p, F.struct("turn", "role", "rendered", "loss")))).alias(p)
        for p in ("prompt", "chosen", "rejected")])

    def text(p):
        return F.array_join(F.transform(p, lambda x: x["rendered"]), "")

    def spans(p):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("found"))
        def step(s, x):
            to = s["at"] + F.length(x["rendered"])
            span = F.array(F.struct(s["at"].alias("from"), to.alias("to")))
            return F.struct(to.alias("at"), F.when(x["loss"], F.concat(s["found"], span)).otherwise(s["found"]).alias("found"))
        return F.aggregate(p, start, step, lambda s: s["found"])

    return out.select("pair_id", text("prompt").alias("prompt"), text("chosen").alias("chosen"),
                      text("rejected").alias("rejected"), spans("chosen").alias("chosen_loss"),
                      spans("rejected").alias("rejected_loss"))


def placed(parts: DataFrame) -> DataFrame:
    """The segments with ``at``: the characters of their part (prompt, chosen or rejected) in front of them.

    Turns are first added up per block of 256 turn numbers, the blocks are added up per part, and a segment's offset
    is its block's plus what stands before it in the block; so a conversation with very many turns is many small groups.
    """
    cut = parts.withColumns({"block": F.shiftright("turn", BLOCK_BITS), "chars": F.length("rendered").cast("long")})
    sums = cut.groupBy("pair_id", "part", "block").agg(F.sum("chars").alias("chars"))
    before = W.partitionBy("pair_id", "part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("pair_id").alias("of"), F.col("part").alias("in"), F.col("block").alias("by"),
                       F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("from"))
    inside = W.partitionBy("pair_id", "part", "block").orderBy("turn", "role", "rendered").rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum("chars").over(inside), F.lit(0))
    joined = cut.join(sums, F.col("pair_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")) & (F.col("block") == F.col("by")))
    return joined.select("pair_id", "part", "turn", "role", "rendered", "loss", (F.col("from") + own).alias("at"), "chars")


def pairs(parts: DataFrame, row_chars: int = ROW_CHARS) -> DataFrame:
    """Paired masked completions: pair_id, piece, n_pieces, prompt, chosen, rejected, and the character spans [from, to) with a
    loss in chosen and rejected.

    A pair whose parts have at most ``row_chars`` characters each is one row, ready for training. A longer one has several
    rows, of as many characters a part as that (and one segment more at most): its parts are the pieces' texts one
    after the other, and spans count from the part's begin, so nothing is cut off and no row grows with a conversation.
    """
    rows = placed(parts).withColumn("piece", F.floor(F.col("at") / row_chars).cast("long"))
    item = F.struct("at", "turn", "role", "rendered", "loss", "chars")
    out = rows.groupBy("pair_id", "piece").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("part") == p, item))).alias(p) for p in ("prompt", "chosen", "rejected")])
    ends = rows.groupBy("pair_id").agg(F.countDistinct("piece").alias("n_pieces")).withColumnRenamed("pair_id", "of")

    def text(p):
        return F.array_join(F.transform(p, lambda x: x["rendered"]), "")

    def spans(p):
        return F.transform(F.filter(p, lambda x: x["loss"]), lambda x: F.struct(x["at"].alias("from"), (x["at"] + x["chars"]).alias("to")))

    return out.join(ends, F.col("pair_id").eqNullSafe(F.col("of"))).select(
        "pair_id", "piece", "n_pieces", text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"),
        spans("chosen").alias("chosen_loss"), spans("rejected").alias("rejected_loss"))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs out of plain conversations: each one as it is, and with its last reply taken from its neighbour (id xor 1).

    A conversation whose neighbour has no reply is rejected in favour of itself without that reply.
    """
    c = turns(conversations, pair="conv_id")
    last = c.where(F.col("role") == "assistant").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("reply"))
    own = last.select(F.col("pair_id").alias("own_id"), F.col("reply.turn").alias("last_turn"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("other_id"), F.col("reply.text").alias("other_text"))
    swap = own.join(other, F.col("own_id") == F.col("other_id"), "left").drop("other_id")
    joined = c.join(swap, F.col("pair_id").eqNullSafe(F.col("own_id")), "left")
    reply = (F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn"))
    rejected = joined.withColumn("text", F.when(F.coalesce(reply, F.lit(False)), F.col("other_text")).otherwise(F.col("text")))
    return c, rejected.where(F.col("text").isNotNull()).select("pair_id", "turn", "role", "text")
