"""Exact top-k by inner product over a forest of M-trees.

Vectors of one length, given a further component that levels their norms, lie on a sphere of radius R; then
``distance(q, x)^2 = |q|^2 + R^2 - 2 <q, x>``, so the highest scores are the nearest vectors and distances obey the
triangle inequality. Vectors are dealt to the nearest of some pivots, large cells are split by hash, and each part
becomes an M-tree of pages: an entry stores its object, its covering radius and its distance to the page's parent.
A query takes pages best-first, and an entry is skipped without computing its distance when
``|d(q, parent) - d(entry, parent)|`` already exceeds what could help. Each query first searches the tree of its own
cell; the k-th score found there is the starting bound in all the others. Which others those are is decided before
anything is shuffled to them: every tree has one small row (the object nearest to its centre, and the radius that covers
the tree), and a query goes only to trees whose nearest possible vector is near enough.

The pivots are a sample of at most 256 vectors (it only steers the layout); every vector is in a tree, and the search
is exact. Queries and trees, and queries and tree rows, meet in groups of bounded size; nothing is collected.

Defined results: vectors that are null, hold null or non-finite components, or have no id take no part; an empty table
gives no rows; a query meets the vectors of its own length, all but those with its id; fewer than k others give fewer
rows; equal scores go to the smaller id; repeated vectors are candidates as often as they occur, a repeated query row
asks once. Where a squared norm reaches 2^52, sums are carried in 64-bit mantissas instead of 53-bit ones, so scores stay
exact; a vector whose squared norm reaches 2^62 takes no part, since its scores need not fit a long.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, written

LEAF = 128
FANOUT = 16
TREE_ROWS = 4096
TREE_BLOCK = 1024
MOST_NORM = 2.0**62
QUERY_BLOCK = 2048
MOST_PIVOTS = 256
PAGES = "tree int, page int, leaf boolean, ids binary, vectors binary, radii binary, to_parent binary, router binary"


def integers(df: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """id, dim, norm2 (rounded where it is beyond 2^53) and the floored components (64-bit) of every vector that takes part."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(fine)

    def floored(batches):
        for batch in batches:
            column = batch.column(1)
            with np.errstate(over="ignore"):
                parts = [np.floor(scale * np.asarray(x, np.float64)) for x in column.to_numpy(zero_copy_only=False)]
                norms = [float(p @ p) for p in parts]
            kept = [i for i, n in enumerate(norms) if n < MOST_NORM]
            yield [batch.column(0).take(pa.array(kept, pa.int32())), pa.array([len(parts[i]) for i in kept], pa.int32()),
                   pa.array([int(norms[i]) for i in kept], pa.int64()),
                   pa.array([parts[i].astype("<i8").tobytes() for i in kept], pa.binary())]

    return arrow_map(rows, floored, "id long, dim int, norm2 long, v binary")


@dataclass(frozen=True)
class Numbers:
    """How components are stored, and the floating numbers whose mantissa holds every score."""

    stored: str
    real: type

    @classmethod
    def up_to(cls, norm: float) -> Numbers:
        return cls("<i4" if norm < 2.0**62 and math.sqrt(norm) < 2**31 else "<i8", np.float64 if norm < 2.0**52 else np.longdouble)

    def matrix(self, column) -> np.ndarray:
        return np.stack([np.frombuffer(x, self.stored) for x in column]).astype(self.real) if len(column) else np.zeros((0, 0))

    def vector(self, x: bytes) -> np.ndarray:
        return np.frombuffer(x, self.stored).astype(self.real)

    def pack(self, v: np.ndarray) -> bytes:
        return v.astype(self.stored).tobytes()


SMALL = Numbers("<i4", np.float64)


def _between(a: np.ndarray, b: np.ndarray, sphere: float) -> np.ndarray:
    """Distances of levelled vectors: each row of a and of b."""
    level = np.sqrt(np.maximum(sphere - (a * a).sum(1), 0)), np.sqrt(np.maximum(sphere - (b * b).sum(1), 0))
    return np.sqrt(np.maximum(2 * sphere - 2 * (a @ b.T + np.outer(*level)), 0))


def build(tree: int, ids: np.ndarray, v: np.ndarray, sphere: float, numbers: Numbers = SMALL) -> pd.DataFrame:
    """The pages of one tree; page 0 is the root and its router the vector nearest to the centre."""
    centre = int(((v - v.mean(0)) ** 2).sum(1).argmin())
    rng, pages, work = np.random.default_rng(tree), [], [(0, np.arange(len(v)), centre)]
    made = 1
    while work:
        page, rows, router = work.pop()
        if len(rows) <= LEAF:
            to_parent = _between(v[rows], v[[router]], sphere)[:, 0]
            pages.append((tree, page, True, ids[rows].tobytes(), numbers.pack(v[rows]), b"",
                          to_parent.astype(float).tobytes(), numbers.pack(v[router])))
            continue
        n = min(FANOUT, -(-len(rows) // LEAF))
        chosen = rng.choice(rows, n, replace=False)
        near = _between(v[rows], v[chosen], sphere)
        owner = near.argmin(1)
        if np.bincount(owner, minlength=n).max() == len(rows):  # equal vectors: any division will do
            owner = np.arange(len(rows)) * n // len(rows)
            chosen = np.array([rows[np.flatnonzero(owner == k)[0]] for k in range(n)])
            near = _between(v[rows], v[chosen], sphere)
        kept = [k for k in range(n) if (owner == k).any()]
        radii = np.array([near[owner == k, k].max() for k in kept])
        children = np.arange(made, made + len(kept))
        made += len(kept)
        routers = chosen[kept]
        to_parent = _between(v[routers], v[[router]], sphere)[:, 0]
        pages.append((tree, page, False, children.astype(np.int64).tobytes(), numbers.pack(v[routers]),
                      radii.astype(float).tobytes(), to_parent.astype(float).tobytes(), numbers.pack(v[router])))
        work += [(int(c), rows[owner == k], int(r)) for c, k, r in zip(children, kept, routers, strict=True)]
    return pd.DataFrame(pages, columns=[c.split()[0] for c in PAGES.split(", ")])


SLACK = 1e-6


def farthest(lift: float, score: float) -> float:
    """The distance of a vector with that score (infinite, if there is none): lift is |q|^2 + R^2."""
    return math.sqrt(max(lift - 2 * score, 0)) if score > -math.inf else math.inf


def in_reach(queries: np.ndarray, bounds: np.ndarray, routers: np.ndarray, radii: np.ndarray, sphere: float) -> np.ndarray:
    """For each query and tree: may a vector of the tree score ``bounds`` or more?"""
    lift = (queries * queries).sum(1) + sphere
    near = np.sqrt(np.maximum(lift[:, None] - 2 * (queries @ routers.T), 0)) - radii
    limit = [farthest(float(x), b) + SLACK * math.sqrt(float(x) + 1) for x, b in zip(lift, bounds, strict=True)]
    return near <= np.array(limit)[:, None]


class Tree:
    def __init__(self, pages: pd.DataFrame, dim: int, sphere: float, numbers: Numbers = SMALL):
        self.sphere, self.pages = sphere, {}
        for p in pages.itertuples(index=False):
            ids = np.frombuffer(p.ids, np.int64)
            self.pages[p.page] = (p.leaf, ids, numbers.vector(p.vectors).reshape(len(ids), dim),
                                  np.frombuffer(p.radii), np.frombuffer(p.to_parent))
            if p.page == 0:
                self.router = numbers.vector(p.router)

    def search(self, own: int, q: np.ndarray, k: int, bound: float) -> list[tuple[int, int]]:
        """The k best (-score, id) with a score of at least ``bound``, ids other than ``own``."""
        q2 = float(q @ q)
        lift = q2 + self.sphere
        slack = SLACK * math.sqrt(lift + 1)

        def reach(score):
            return farthest(lift, score) + slack

        limit, best = reach(bound), []
        work = [(0.0, 0, math.sqrt(max(lift - 2 * float(self.router @ q), 0)))]
        while work:
            nearest, page, d_parent = heapq.heappop(work)
            if nearest > limit:
                break
            leaf, ids, vectors, radii, to_parent = self.pages[page]
            least = np.abs(d_parent - to_parent)
            if not leaf:
                least = least - radii
            maybe = np.flatnonzero(least <= limit)
            if not len(maybe):
                continue
            scores = vectors[maybe] @ q if len(maybe) < len(ids) else vectors @ q
            if leaf:
                good = np.flatnonzero(scores >= bound)
                if len(good):
                    found = [(-int(scores[i]), int(ids[maybe[i]])) for i in good]
                    best = heapq.nsmallest(k, best + [f for f in found if f[1] != own])
                    if len(best) == k and -best[-1][0] > bound:
                        bound = -best[-1][0]
                        limit = reach(bound)
                continue
            d = np.sqrt(np.maximum(lift - 2 * scores, 0))
            low = np.maximum(np.maximum(d - radii[maybe], least[maybe]), 0)
            for i in np.flatnonzero(low <= limit):
                heapq.heappush(work, (float(low[i]), int(ids[maybe[i]]), float(d[i])))
        return best


def reachable(queries: DataFrame, pages: DataFrame, trees: DataFrame, n_blocks: int, sphere: float, numbers: Numbers) -> DataFrame:
    """(query_id, q, block, bound, tree): the trees other than its own that may still help a query.

    A block of queries meets blocks of ``TREE_BLOCK`` tree rows.
    """
    def summary(batches):
        for batch in batches:
            for tree, router, radii, to_parent in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                covered = np.frombuffer(to_parent) + (np.frombuffer(radii) if radii else 0.0)
                yield [pa.array([tree], pa.int32()), pa.array([router], pa.binary()), pa.array([float(covered.max(initial=0))])]

    roots = arrow_map(pages.where("page = 0").select("tree", "router", "radii", "to_parent"), summary, "tree int, router binary, radius double")
    roots = roots.withColumn("trees", F.floor(F.col("tree") / TREE_BLOCK).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    spans = trees.groupBy(F.col("of_dim").alias("t_dim")).agg(  # a row for each vector length
        F.min("first_tree").alias("from"), F.max(F.col("first_tree") + F.col("salts")).alias("to"))
    asked = queries.join(F.broadcast(spans), F.col("of_dim") == F.col("t_dim")).withColumn(
        "trees", F.explode(F.sequence(F.floor(F.col("from") / TREE_BLOCK).cast("int"), F.floor((F.col("to") - 1) / TREE_BLOCK).cast("int"))))

    def choose(some: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = []
        for span, of in some.groupby(["from", "to"]) if len(some) and len(near) else ():
            there = near[(near["tree"] >= span[0]) & (near["tree"] < span[1])]
            if len(there):
                bounds = np.array([-math.inf if b is None or b != b else float(b) for b in of["bound"]])
                fine = in_reach(numbers.matrix(list(of["q"])), bounds, numbers.matrix(list(there["router"])),
                                there["radius"].to_numpy(), sphere)
                fine &= of["home"].to_numpy()[:, None] != there["tree"].to_numpy()
                row, tree = np.nonzero(fine)
                out.append(of[["query_id", "q", "block", "bound"]].iloc[row].assign(tree=there["tree"].to_numpy()[tree]))
        return pd.concat(out) if out else pd.DataFrame([], columns=["query_id", "q", "block", "bound", "tree"])

    return asked.groupBy("block", "trees").cogroup(roots.groupBy("block", "trees")).applyInPandas(
        choose, "query_id long, q binary, block int, bound double, tree int")


def top_k(df: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
          scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors for each row of ``df`` where ``is_query`` (a column) holds."""
    asks = df.where(F.coalesce(is_query, F.lit(False)))
    vectors = written(integers(df, id_column, vector_column, scale), "vectors")
    whole = vectors.agg(F.count("*").alias("n"), F.max("norm2").alias("most")).first()
    sphere = float(whole["most"] or 0)
    numbers, wide = Numbers.up_to(sphere), Numbers("<i8", np.float64)
    n_pivots = min(MOST_PIVOTS, -(-whole["n"] // TREE_ROWS))
    pivots: dict[int, list[np.ndarray]] = {}
    for r in vectors.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect():
        pivots.setdefault(r["dim"], []).append(wide.vector(r["v"]))

    def cells(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            values = batch.column(3).to_pylist()
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                if int(dim) in pivots:
                    at = np.flatnonzero(dims == dim)
                    p = np.stack(pivots[int(dim)])
                    for a in range(0, len(at), 4096):
                        part = at[a:a + 4096]
                        cell[part] = _between(wide.matrix([values[i] for i in part]), p, sphere).argmin(1)
            packed = batch.column(3) if numbers.stored == wide.stored else pa.array([numbers.pack(np.frombuffer(x, "<i8")) for x in values], pa.binary())
            yield [batch.column(0), batch.column(1), pa.array(cell), packed]

    def dealt(rows):
        return arrow_map(rows, cells, "id long, dim int, cell int, v binary")

    placed = written(dealt(vectors), "cells")
    cell_sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("rows"))
    trees = written(cell_sizes.select(
        F.col("dim").alias("of_dim"), F.col("cell").alias("of_cell"), F.ceil(F.col("rows") / TREE_ROWS).cast("int").alias("salts"),
        (F.sum(F.ceil(F.col("rows") / TREE_ROWS)).over(W.orderBy("dim", "cell")) - F.ceil(F.col("rows") / TREE_ROWS))
        .cast("int").alias("first_tree")), "trees")

    def in_tree(rows):  # one row for each (length, pivot): bounded by the pivots and the lengths
        return rows.join(F.broadcast(trees), (F.col("dim") == F.col("of_dim")) & (F.col("cell") == F.col("of_cell"))).withColumn(
            "tree", (F.col("first_tree") + F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return build(int(pdf["tree"].iloc[0]), pdf["id"].to_numpy(np.int64), numbers.matrix(list(pdf["v"])), sphere, numbers)

    pages = in_tree(placed).select("tree", "id", "v").groupBy("tree").applyInPandas(grow, PAGES)
    pages = written(pages, "mtree")

    queries = in_tree(dealt(integers(asks, id_column, vector_column, scale))).select(
        F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("tree").alias("home"), "of_dim").distinct()
    queries = written(queries, "queries")
    n_blocks = -(-queries.count() // QUERY_BLOCK) or 1
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))

    def ask(group_pages: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(group_pages) and len(group):
            tree = Tree(group_pages, len(group["q"].iloc[0]) // np.dtype(numbers.stored).itemsize, sphere, numbers)
            for q in group.itertuples(index=False):
                bound = -math.inf if q.bound is None or q.bound != q.bound else float(q.bound)
                for s, i in tree.search(q.query_id, numbers.vector(q.q), k, bound):
                    out.append((q.query_id, q.q, i, int(-s)))
        return pd.DataFrame(out, columns=["query_id", "q", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    result = "query_id long, q binary, vec_id long, score long"
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    paged = pages.select("*", blocks)

    def search(rows):
        return paged.groupBy("tree", "block").cogroup(rows.groupBy("tree", "block")).applyInPandas(ask, result)

    no_bound = F.lit(None).cast("double").alias("bound")
    home = written(search(queries.select("query_id", "q", F.col("home").alias("tree"), "block", no_bound)), "home")
    bounds = home.groupBy("query_id", "q").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
    bounds = bounds.select(F.col("query_id").alias("b_id"), F.col("q").alias("b_q"), F.when(F.col("n") >= k, F.col("least") - F.abs("least") * (0.0 if numbers.real is np.float64 else 1e-15)).alias("bound"))
    known = queries.join(bounds, (F.col("query_id") == F.col("b_id")) & (F.col("q") == F.col("b_q")), "left")
    rest = reachable(known, pages, trees, n_blocks, sphere, numbers)
    found = home.unionByName(search(rest.select("query_id", "q", "tree", "block", "bound")))
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
