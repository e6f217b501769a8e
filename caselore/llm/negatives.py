"""Hard negatives: for each anchor and each of its positives the best rows of other labels inside a band below the positive.

Scores are integer inner products, computed by packed products (``kronecker``). Rows are dealt into blocks by hash: a
group of labels has as many blocks as its rows need, so that one label with most of the rows is many blocks. Anchors meet
the blocks of their own label's group first (positives), then all blocks (negatives); a block of anchors and a block of
candidates are one task's work of bounded size, and only the best few of each block leave it. Nothing is collected but
the sizes of the label groups, ``LABEL_GROUPS`` numbers.

Every anchor meets every row, which the contract asks for; that is the work of the job, and blocks of ``ANCHOR_BLOCK`` by
``ROW_BLOCK`` keep what is sent to tasks at anchors / ``ANCHOR_BLOCK`` copies of the table.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; nor does a
row whose squared norm reaches 2^56, for its scores need not fit a long hundredfold; rows meet those of their own length;
an anchor's own rows are all those with its id; a repeated anchor row asks once, repeated candidates count as often as they
occur; equal scores go to the smaller id; fewer rows than asked for give fewer; an anchor without positives has no rows; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, written
from .kronecker import Packed

LABEL_GROUPS = 64
ANCHOR_BLOCK = 8192
ROW_BLOCK = 16384
MOST_NORM = 2**56


def integers(df: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int = 256) -> DataFrame:
    """id, label, dim and the floored components (of the fewest bytes that hold them) of every row that takes part."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(fine)

    def packed(v: np.ndarray) -> bytes:
        most = float(np.abs(v).max(initial=0))
        return v.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8").tobytes()

    def floored(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                parts = [np.floor(scale * np.asarray(x, np.float64)) for x in batch.column(2).to_numpy(zero_copy_only=False)]
                kept = [i for i, p in enumerate(parts) if float(p @ p) < MOST_NORM]
            of = pa.array(kept, pa.int32())
            yield [batch.column(0).take(of), batch.column(1).take(of), pa.array([len(parts[i]) for i in kept], pa.int32()),
                   pa.array([packed(parts[i]) for i in kept], pa.binary())]

    return arrow_map(rows, floored, "id long, label long, dim int, v binary").withColumn(
        "group", F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int"))


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for k, x in enumerate(column):
        if dim:
            out[k] = np.frombuffer(x, f"<i{len(x) // dim}")
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, equal ones by the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _scored(anchors: pd.DataFrame, rows: pd.DataFrame):
    """(anchor row, ids, labels, exact scores) of one block of anchors against one block of rows, by length."""
    for dim, of in rows.groupby("dim"):
        asks = anchors[anchors["dim"] == dim]
        if len(asks):
            a = _matrix(asks["v"], dim)
            packed = Packed(_matrix(of["v"], dim), int(a.min(initial=0)), int(a.max(initial=0)))
            ids, labels = of["id"].to_numpy(), of["label"].to_numpy()
            for anchor, v in zip(asks.itertuples(index=False), a, strict=True):
                yield anchor, ids, labels, packed.scores(v).astype(np.int64)


def _cogroup(anchors: DataFrame, rows: DataFrame, fn, schema: str) -> DataFrame:
    return anchors.groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(fn, schema)


def _sizes(rows: DataFrame) -> dict[int, int]:
    """Rows of each label group: LABEL_GROUPS numbers at most."""
    return {r["group"]: r["n"] for r in rows.groupBy("group").agg(F.count("*").alias("n")).collect()}


def _blocks(sizes: dict[int, int], most: int) -> Column:
    """How many blocks the rows of the column ``group`` fill."""
    pairs = [F.lit(x) for group, n in sizes.items() for x in (group, -(-n // most))]
    return F.coalesce(F.create_map(*pairs)[F.col("group")], F.lit(1)) if pairs else F.lit(1)


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id", "v"), blocks).cast("int")


def _each(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, id_column: str = "vec_id", vector_column: str = "embedding",
                   label_column: str = "label", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` is a condition over the columns of ``df``; ``label`` replaces the label where it is given. A negative's
    score is from ``low`` to ``high`` percent of the positive's.
    """
    label_now = F.col(label_column) if label is None else label
    named = df.select(F.col(id_column).alias("id"), label_now.alias("label"), F.col(vector_column).alias("v"),
                      F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = written(integers(named, "id", "v", "label", scale), "vectors")
    asks = written(integers(named.where("asks"), "id", "v", "label", scale).distinct(), "anchors")
    sizes, ask_sizes = _sizes(rows), _sizes(asks)
    row_blocks, own_blocks = _blocks(sizes, ROW_BLOCK), _blocks(ask_sizes, ANCHOR_BLOCK)
    all_blocks = F.lit(-(-sum(ask_sizes.values()) // ANCHOR_BLOCK) or 1)
    rows = rows.withColumn("block", _dealt(row_blocks))

    own = asks.withColumn("a_block", _dealt(own_blocks)).withColumn("block", _each(row_blocks))
    mates = rows.where(F.col("group").isin(list(ask_sizes))).withColumn("a_block", _each(own_blocks))
    part = F.xxhash64("group", "block", "a_block").alias("part")

    def near(group: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(group) and len(others):
            for a, ids, labels, scores in _scored(group, others):
                at = np.flatnonzero((labels == a.label) & (ids != a.id))
                out += [(a.id, a.label, a.v, int(ids[at[i]]), int(scores[at[i]])) for i in best(scores[at], ids[at], positives)]
        return pd.DataFrame(out, columns=["id", "label", "v", "positive_id", "positive_score"])

    met = _cogroup(own.select(part, "dim", "id", "label", "v"), mates.select(part, "dim", "id", "label", "v"), near,
                   "id long, label long, v binary, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("id", "label", "v").orderBy(F.desc("positive_score"), "positive_id"))
    found = met.withColumn("place", place).where(F.col("place") <= positives).groupBy("id", "label", "v").agg(
        F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found"))
    known = written(asks.drop("group").join(found, ["id", "label", "v"]), "positives")

    every = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(-(-n // ROW_BLOCK)).alias("blocks")) for g, n in sizes.items()]
                    or [F.struct(F.lit(0).alias("group"), F.lit(1).alias("blocks"))])
    meets = known.withColumn("a_block", _dealt(all_blocks)).select("*", F.explode(every).alias("of")).select(
        "*", "of.group", _each(F.col("of.blocks")).alias("block"))
    meets = meets.select(part, "dim", "id", "label", "v", F.col("found.positive_id").alias("p_ids"),
                         F.col("found.positive_score").alias("p_scores"))

    def far(group: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(group) and len(others):
            for a, ids, labels, scores in _scored(group, others):
                other = np.flatnonzero(labels != a.label)
                hundred = 100 * scores[other]
                for place, (p, s) in enumerate(zip(a.p_ids, a.p_scores, strict=True)):
                    inside = other[(hundred >= low * int(s)) & (hundred <= high * int(s))]
                    out += [(a.id, a.label, a.v, place, int(p), int(s), int(ids[inside[i]]), int(scores[inside[i]]))
                            for i in best(scores[inside], ids[inside], negatives)]
        return pd.DataFrame(out, columns=["id", "label", "v", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    candidates = rows.withColumn("a_block", _each(all_blocks)).select(part, "dim", "id", "label", "v")
    got = _cogroup(meets, candidates, far,
                   "id long, label long, v binary, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("id", "label", "v", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
