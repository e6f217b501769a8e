"""The vector table: rows per pattern, ids, upsert, delete, and exact nearest neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import fixed_values as V
from ..functions import text as T
from ..functions.embed import Embed
from ..session import materialise

SHIP_LIMIT = 64 * 1024 * 1024  # bytes of an index that goes to every executor whole
CELLS = 2_000_000  # scores that a Python worker holds at once
PIECE = 4 * 1024 * 1024  # bytes of the index in one written block
PIECE_ROWS = 16_384  # index rows that a block of queries meets at once
SCORE_PLACES = 9  # equal vectors must score equally whatever the order of the additions


def pack_vector_id(pattern_id: Column, slot: Column) -> Column:
    base = F.conv(pattern_id, 16, 10).cast("bigint")
    return F.shiftleft(base, V.SLOT_BITS).bitwiseOR(slot.cast("bigint"))


def unpack_pattern(vec_id: Column) -> Column:
    """The 10-digit hex pattern id inside a vector id."""
    return F.lpad(F.lower(F.hex(F.shiftright(vec_id, V.SLOT_BITS))), 10, "0")


def unpack_slot(vec_id: Column) -> Column:
    return vec_id.bitwiseAND(F.lit(V.SLOTS - 1).cast("bigint")).cast("int")


def index_rows(patterns: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """One row per label (slot 0) and per example complaint (slots 1..15)."""
    label = T.pattern_text(*[F.col(c) for c in V.LABELS])
    if examples is None:
        texts = patterns.select("pattern_id", F.array(label).alias("texts"))
    else:
        known = patterns.select("pattern_id", *V.LABELS)
        texts = known.join(examples.select("pattern_id", "complaints"), "pattern_id", "left").select(
            "pattern_id",
            F.slice(F.concat(F.array(label), F.coalesce("complaints", F.array().cast("array<string>"))), 1, V.SLOTS)
            .alias("texts"))
    out = texts.select("pattern_id", F.posexplode("texts").alias("slot", "text"))
    return out.select(pack_vector_id(F.col("pattern_id"), F.col("slot")).alias("vec_id"), "pattern_id", "slot", "text")


def embed_rows(rows: DataFrame, embed: Embed) -> DataFrame:
    return rows.withColumn("embedding", embed(F.col("text")))


def id_check(vectors: DataFrame) -> DataFrame:
    """Vectors, distinct ids, and whether they agree."""
    per_id = vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.count(F.lit(1)).alias("ids"),
                      (F.coalesce(F.max("n"), F.lit(1)) == 1).alias("ids_unique"))


def check_dim(vectors: DataFrame, dim: int) -> DataFrame:
    """Fails the job on the first vector of another length."""
    ok = F.size("embedding") == dim
    message = F.concat(F.lit(f"expected vectors of length {dim}, got "), F.size("embedding").cast("string"))
    return vectors.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(message)))


def remove_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("vec_id"), "vec_id", "left_anti")


def upsert_vectors(vectors: DataFrame, new: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows with a known id are replaced, the others added."""
    if dim is not None:
        new = check_dim(new, dim)
    return remove_vectors(vectors, new).unionByName(new)


def index_manifest(vectors: DataFrame, patterns: DataFrame, model: str) -> DataFrame:
    v = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(unpack_slot(F.col("vec_id")) > 0).alias("example_vectors"),
                    F.max(F.size("embedding")).alias("dim"))
    return v.select(
        F.lit(model).alias("model_name"),
        F.when(F.col("example_vectors") > 0, "label + synthetic example complaints").otherwise("label only")
        .alias("doc_format"),
        patterns.agg(F.count(F.lit(1))).scalar().alias("patterns"), "example_vectors", "dim", "n")


def guard_model(index_model: str, query_model: str) -> None:
    if index_model != query_model:
        raise ValueError(f"index built with {index_model}, queries use {query_model}")


# --- nearest neighbours ------------------------------------------------------


def _matrix(column) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    n = len(arr)
    return arr.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1) if n else np.zeros((0, 0))


def _best(queries: np.ndarray, index: np.ndarray, k: int):
    """Row numbers of the k best index rows per query, best first, ties by row number."""
    k = min(k, len(index))
    step = max(1, CELLS // max(1, len(index)))
    for start in range(0, len(queries), step):
        scores = queries[start:start + step] @ index.T
        np.round(scores, SCORE_PLACES, out=scores)
        scores += 0.0
        edge = np.partition(scores, len(index) - k, axis=1)[:, len(index) - k]
        for row, low in zip(scores, edge):
            near = np.flatnonzero(row >= low)
            near = near[np.argsort(-row[near], kind="stable")[:k]]
            yield near, row[near]


def _as_lists(payload: pa.Table, places: np.ndarray, scores: np.ndarray, sizes: np.ndarray) -> pa.Array:
    take = pa.array(places)
    cols = [payload.column(c).combine_chunks().take(take) for c in payload.column_names]
    cols = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in cols]
    items = pa.StructArray.from_arrays([*cols, pa.array(scores)], [*payload.column_names, "score"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items)


def _neighbour_lists(queries, index: np.ndarray, payload: pa.Table, k: int) -> pa.Array:
    none = (np.zeros(0, "int64"), np.zeros(0))
    lists = [*_best(_matrix(queries), index, k)] if len(index) else [none] * len(queries)
    picks, scores = (np.concatenate([none[i], *[x[i] for x in lists]]) for i in (0, 1))
    return _as_lists(payload, picks, scores, np.array([len(near) for near, _ in lists], "int64"))


class _Nearest:
    """The k best index rows of each query of a block, while the index comes piece by piece, in any order.

    Once a query has k rows, a piece is compared in single precision first: what cannot reach the k-th score even if single
    precision is as far off as it can be is left out, the rest is scored exactly. Rows found are merged when there are as many
    as are kept.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        with np.errstate(over="ignore"):
            self.short = queries.astype("float32")
        self.norms = np.linalg.norm(queries, axis=1)
        self.low = np.full(len(queries), -np.inf)  # the k-th score, once there are k
        self.best = tuple(np.zeros(0, t) for t in ("int32", "float64", "int64", "int64"))  # query, score, vec_id, place
        self.found, self.waiting = [], 0

    def add(self, vectors: np.ndarray, ids: np.ndarray, first: int) -> None:
        """A piece of the index whose rows have the places from ``first`` on."""
        order = np.argsort(ids, kind="stable")
        vectors, ids, places = vectors[order], ids[order], first + order
        with np.errstate(over="ignore", invalid="ignore"):
            short = vectors.astype("float32")
            off = (vectors.shape[1] + 8) * 2.0 ** -23 * self.norms * np.linalg.norm(vectors, axis=1).max()
            edge = np.nextafter((self.low - off - 10.0 ** -SCORE_PLACES).astype("float32"), np.float32("-inf"))
        sure = np.isfinite(edge) & (off < 1e30)
        most, step = 2 * CELLS // max(1, vectors.shape[1]), max(1, CELLS // len(vectors))
        for start in range(0, len(self.queries), step):
            part = slice(start, start + step)
            with np.errstate(invalid="ignore"):
                near = np.flatnonzero(self.short[part] @ short.T >= edge[part, None]) if sure[part].all() else None
            if near is None or len(near) > most:
                lists = [*_best(self.queries[part], vectors, self.k)]
                rows = np.repeat(np.arange(len(lists)), [len(x) for x, _ in lists]) + start
                cols, scores = (np.concatenate([x[i] for x in lists]) for i in (0, 1))
            else:
                rows, cols = np.divmod(near, len(vectors))
                rows += start
                scores = np.round(np.einsum("ij,ij->i", self.queries[rows], vectors[cols]), SCORE_PLACES) + 0.0
            good = scores >= self.low[rows]
            self.found.append((rows[good].astype("int32"), scores[good], ids[cols[good]], places[cols[good]]))
            self.waiting += int(good.sum())
            if self.waiting >= len(self.queries) * self.k:
                self.merge()

    def merge(self) -> None:
        query, score, ids, place = (np.concatenate(c) for c in zip(self.best, *self.found, strict=True))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, rank = order[rank < self.k], query[rank < self.k], rank[rank < self.k]
        self.best, self.found, self.waiting = (query, score[order], ids[order], place[order]), [], 0
        last = rank == self.k - 1
        self.low[query[last]] = self.best[1][last]


def _block(table: pa.Table) -> pa.RecordBatch:
    """Rows as one binary value, an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


def _rows(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def _index_blocks(batches):
    for b in batches:
        n = max(1, PIECE * b.num_rows // max(1, b.nbytes))
        for start in range(0, b.num_rows, n):
            yield _block(pa.Table.from_batches([b.slice(start, n)]))


def _query_block(batches):
    """All rows of the task."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        yield _block(pa.Table.from_batches(batches))


class PreparedIndex:
    """An index ready for ``knn``: measured once, shipped once if it is small, written for block search if it is not.

    Make one per index version and ``release`` it afterwards; ``knn`` on a plain table makes one for itself.
    """

    def __init__(self, index: DataFrame, payload: list[str] = (), broadcast_limit: int = SHIP_LIMIT,
                 shard_rows: int = 50_000):
        self.keep = ["vec_id", *payload]
        rows = index.select(*self.keep, "embedding")
        texts = [c for c in self.keep if isinstance(index.schema[c].dataType, ST.StringType)]
        width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8 * len(self.keep)))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.size("embedding") * 16 + width).cast("bigint")),
                                                                 F.lit(0)).alias("bytes")).first()
        # as Arrow returns them: nullable, whatever the columns of the index promise
        self.item = ST.StructType([ST.StructField(c, rows.schema[c].dataType) for c in self.keep]
                                  + [ST.StructField("score", ST.DoubleType())])
        self.n = size["n"]
        self.shared = self.blocks = None
        if size["bytes"] <= broadcast_limit:
            table = rows.toArrow().sort_by("vec_id")
            context = index.sparkSession.sparkContext
            self.shared = context.broadcast((_matrix(table.column("embedding")), table.select(self.keep)))
        else:
            blocks = rows.repartition(max(1, math.ceil(self.n / shard_rows))).mapInArrow(_index_blocks, "block binary")
            # some large values a file: sizes are looked at after every row, else a hundred are held first
            self.blocks = materialise(blocks, "index", **{
                "parquet.block.size": 4 * PIECE, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1})

    def release(self) -> None:
        if self.shared is not None:
            self.shared.unpersist()


def knn(queries: DataFrame, index: DataFrame | PreparedIndex, k: int, payload: list[str] = (), block_rows: int = 8_192,
        **options) -> DataFrame:
    """Exact top-k inner products: adds ``neighbours array<struct<vec_id, payload.., score>>``, best first.

    Every query row is answered for itself, also if its other columns are null or repeat. The index is measured first,
    payload included. A small one is shipped to every executor once and the queries never move. Beyond that both sides
    are cut into bounded blocks: a task holds one block of queries with their k best so far and reads the blocks of the
    index one after the other. What is written and shuffled is each side once, whatever the number of pairs of blocks;
    nothing is approximated or dropped, and both ways give the same rows.
    """
    if not isinstance(index, PreparedIndex):
        index = PreparedIndex(index, payload, **options)
    return _knn_shipped(queries, index, k) if index.shared is not None else _knn_blocks(queries, index, k, block_rows)


def _knn_shipped(queries: DataFrame, index: PreparedIndex, k: int) -> DataFrame:
    shared = index.shared
    fields = [f for f in queries.schema.fields if f.name != "embedding"]

    def search(batches):
        vectors, payload = shared.value
        for b in batches:
            lists = _neighbour_lists(b.column("embedding"), vectors, payload, k)
            names = [c for c in b.schema.names if c != "embedding"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], lists], [*names, "neighbours"])

    return queries.mapInArrow(search, ST.StructType([*fields, ST.StructField("neighbours", ST.ArrayType(index.item))]))


def _knn_blocks(queries: DataFrame, index: PreparedIndex, k: int, block_rows: int) -> DataFrame:
    schema = ST.StructType([*[f for f in queries.schema.fields if f.name != "embedding"],
                            ST.StructField("neighbours", ST.ArrayType(index.item))])
    if not index.n:
        return queries.drop("embedding").withColumn("neighbours", F.array().cast(schema["neighbours"].dataType))
    keep = index.keep
    queries = materialise(queries, "queries")
    n = queries.count()
    # at most block_rows in a task; fewer where that keeps all cores busy
    tasks = max(1, math.ceil(n / block_rows), min(math.ceil(n / 1_000), 3 * queries.sparkSession.sparkContext.defaultParallelism))
    # a product with one partition on the left: each task reads the blocks of the index beside its one block of queries
    pairs = index.blocks.coalesce(1).withColumnRenamed("block", "index_block").crossJoin(
        queries.repartition(tasks).mapInArrow(_query_block, "block binary").hint("shuffle_replicate_nl"))

    def search(batches):
        near = asked = store = None
        waiting = []

        def meet():
            nonlocal store, waiting
            piece, waiting = pa.concat_tables(waiting), []
            ids = pc.fill_null(piece.column("vec_id").cast(pa.int64()), 2 ** 63 - 1)
            near.add(_matrix(piece.column("embedding")), ids.to_numpy(), store.num_rows if store else 0)
            kept = piece.select(keep).take(np.arange(piece.num_rows))  # a copy, so that the vectors can go
            store = pa.concat_tables([store, kept]) if store else kept
            if store.num_rows > 4 * len(near.queries) * k:
                near.merge()
                used, places = np.unique(near.best[3], return_inverse=True)
                store, near.best = store.take(used).combine_chunks(), (*near.best[:3], places)

        for b in batches:
            for index_block, query_block in zip(b.column("index_block"), b.column("block"), strict=True):
                if near is None:
                    asked = _rows(query_block)
                    asked = asked.take(np.arange(asked.num_rows))
                    near = _Nearest(_matrix(asked.column("embedding")), k)
                waiting.append(_rows(index_block))
                # pieces grow with what was read before, so that most of a piece is ruled out by then
                if sum(t.num_rows for t in waiting) >= min(PIECE_ROWS, store.num_rows if store else 1):
                    meet()
        if near is None:
            return
        if waiting:
            meet()
        near.merge()
        query, scores, _, places = near.best
        ends = np.searchsorted(query, np.arange(asked.num_rows + 1))
        for start in range(0, asked.num_rows, 1_000):
            some = asked.slice(start, 1_000)
            bounds = ends[start:start + some.num_rows + 1]
            part = slice(bounds[0], bounds[-1])
            lists = _as_lists(store, places[part], scores[part], np.diff(bounds))
            yield from some.append_column("neighbours", lists).drop_columns("embedding").combine_chunks().to_batches()

    return pairs.mapInArrow(search, schema)
