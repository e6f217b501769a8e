"""Best-fit-decreasing sharding: groups that must stay together go, largest first, into the tightest shard with room.

The packing runs over *items*. A group of at least a 256th of a shard is an item of its own (at most 256 times the
number of shards can be so large); smaller groups are gathered by the hash of their key into 256 crates a shard. So
the number of items depends on the number of shards, never on the data, and one task packs them however many rows
there are. More than 256 shards are packed as independent regions of the hash space, one task each. Shards with room
wait in a balanced search tree by remaining capacity.

Rows get a gapless slot in their shard from counts: items have offsets, an item is cut into salted chunks of bounded
size (a hot group too), rows are numbered inside their chunk only.

Defined results: null and empty text are one group of size 0 + overhead; null ids and repeated rows are placed like any
other; an empty table gives no rows; a group larger than the capacity has a shard of its own; equal sizes go in the
order of their item's name, equal room to the shard opened first.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

CRATES = 256
REGION_SHARDS = 256
OVERHEAD = 8


class RoomTree:
    """AVL tree of (room, shard): takes out the least room of at least a size."""

    def __init__(self):
        self.root = None  # node: [key, left, right, height]

    @staticmethod
    def _level(n):
        n[3] = 1 + max(n[1][3] if n[1] else 0, n[2][3] if n[2] else 0)

    def _balance(self, n):
        self._level(n)
        for side, other in ((1, 2), (2, 1)):
            child = n[side]
            if child and child[3] > 1 + (n[other][3] if n[other] else 0):
                inner, outer = child[other], child[side]
                if inner and inner[3] > (outer[3] if outer else 0):
                    child[other], inner[side] = inner[side], child
                    self._level(child)
                    child = inner
                n[side], child[other] = child[other], n
                self._level(n)
                self._level(child)
                return child
        return n

    def add(self, key):
        def put(n):
            if n is None:
                return [key, None, None, 1]
            side = 1 if key < n[0] else 2
            n[side] = put(n[side])
            return self._balance(n)

        self.root = put(self.root)

    def remove(self, key):
        def least(n):
            return least(n[1]) if n[1] else n[0]

        def cut(n, key):
            if key == n[0]:
                if n[1] is None or n[2] is None:
                    return n[1] or n[2]
                n[0] = least(n[2])
                n[2] = cut(n[2], n[0])
            elif key < n[0]:
                n[1] = cut(n[1], key)
            else:
                n[2] = cut(n[2], key)
            return self._balance(n)

        self.root = cut(self.root, key)

    def tightest(self, size):
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                n, best = n[1], n[0]
            else:
                n = n[2]
        return best


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size; sizes must come largest first. A size over the capacity has a bin of its own."""
    tree, bins, out = RoomTree(), 0, []
    for size in sizes:
        found = tree.tightest(size)
        if found:
            tree.remove(found)
            room, b = found
        else:
            room, b, bins = max(capacity, size), bins, bins + 1
        out.append(b)
        tree.add((room - size, b))
    return out


def level_fit(sizes: list[int], bins: int) -> list[int]:
    """Bins with sums as equal as best fit makes them: the least capacity at which ``bins`` bins suffice.

    A size that is larger than the mean of what is left takes a bin alone, and the mean is taken over the rest.
    """
    total, alone = sum(sizes), 0
    while alone < min(bins - 1, len(sizes)) and sizes[alone] * (bins - alone) > total:
        total -= sizes[alone]
        alone += 1
    rest, left = sizes[alone:], bins - alone
    if not rest:
        return list(range(alone))
    low = max(-(-total // left), rest[0])
    high, step = low + rest[0], max(1, low // 20_000)
    best = best_fit(rest, high)
    while high - low > step:
        middle = (low + high) // 2
        tried = best_fit(rest, middle)
        if max(tried) < left:
            high, best = middle, tried
        else:
            low = middle
    return list(range(alone)) + [alone + b for b in best]


def _packed(items: DataFrame, shards: int | None, capacity: int | None) -> DataFrame:
    """Item -> region, local shard, first slot."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True], ignore_index=True)
        sizes = [int(x) for x in pdf["bytes"]]
        pdf["local"] = level_fit(sizes, shards) if shards else best_fit(sizes, capacity)
        pdf["first_slot"] = pdf.groupby("local")["rows"].cumsum() - pdf["rows"]
        return pdf

    return items.groupBy("region").applyInPandas(
        fit, "region int, item string, bytes long, rows long, local long, first_slot long")


def shard(df: DataFrame, shards: int | None = None, capacity: int | None = None, id_column: str = "doc_id",
          text_column: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """id, size, text_crc32, shard, slot; either ``shards`` level ones or as few of ``capacity`` bytes as best fit needs."""
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = written(df.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key")), "sized")
    whole = base.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    wanted = shards or max(1, math.ceil(whole["bytes"] / capacity))
    regions = 1 if shards else math.ceil(wanted / REGION_SHARDS)
    least = max(1, (capacity or whole["bytes"] // wanted) // CRATES)
    crates = CRATES * math.ceil(wanted / regions)
    chunk = max(64, whole["n"] // 4096)

    region = F.pmod(F.xxhash64("key", F.lit("region")), F.lit(regions)).cast("int").alias("region")
    crate = F.concat(region.cast("string"), F.lit(":"), F.pmod(F.xxhash64("key", F.lit("crate")), F.lit(crates)).cast("string"))
    large = (base.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") >= least)
             .select(F.col("key").alias("large_key"), F.hex("key").alias("own")))
    # at most CRATES times the number of shards keys can be so large
    large = F.broadcast(large) if wanted <= 4096 else large
    rows = base.join(large, F.col("key") == F.col("large_key"), "left").select(
        "id", "size", "text_crc32", region, F.coalesce("own", crate).alias("item"))
    items = _packed(rows.groupBy("region", "item").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")),
                    shards, capacity)
    items = written(items, "items")
    used = items.groupBy("region").agg((F.max("local") + 1).alias("used"))
    used = used.select(F.col("region").alias("of"), (F.sum("used").over(W.orderBy("region")) - F.col("used")).alias("before"))
    items = items.join(F.broadcast(used), F.col("region") == F.col("of")).select(
        F.col("item").alias("name"), (F.col("before") + F.col("local")).cast("int").alias("shard"), "first_slot",
        F.ceil(F.col("rows") / chunk).alias("salts"))
    items = F.broadcast(items) if wanted <= 4096 else items
    rows = rows.join(items, F.col("item") == F.col("name")).withColumn(
        "salt", F.pmod(F.xxhash64("id", "size"), F.col("salts")))
    chunks = rows.groupBy("item", "salt").agg(F.count("*").alias("in_chunk"))
    chunks = chunks.select(F.col("item").alias("of_item"), F.col("salt").alias("of_salt"), (F.sum("in_chunk").over(
        W.partitionBy("item").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("in_chunk")).alias("chunk_first"))
    chunks = F.broadcast(chunks) if wanted <= 4096 else chunks  # items and 4,096 more at most
    rows = rows.join(chunks, (F.col("item") == F.col("of_item")) & (F.col("salt") == F.col("of_salt")))
    n = F.row_number().over(W.partitionBy("item", "salt").orderBy("id", "text_crc32"))
    return rows.select(F.col("id").alias(id_column), "size", "text_crc32", "shard",
                       (F.col("first_slot") + F.col("chunk_first") + n - 1).alias("slot"))
