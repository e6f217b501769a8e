"""Near duplicates by SimHash fingerprints, joined on fuzzy keys of the Golay code.

A bit of a text's 64-bit fingerprint is 1 if it is set in more than half of the XXH64 hashes of its three-word shingles,
repeats included. Equal fingerprints are one class. Of the 64 bits three segments are made (22, 21 and 21 bits). If two
fingerprints differ in at most two bits, some segment is free of errors (pigeonhole) and the next one has at most two;
so each class gets keys of a segment as it is together with the Golay keys of the next (``golay``): 3 to 18 keys, and
linked classes share one. Buckets of up to ``BUCKET`` classes are compared exhaustively on the whole fingerprints.

A larger bucket is a family of close fingerprints, which no key divides. Its members are joined by midpoints instead: two
fingerprints within two bits have one within a bit of both, and only 65 fingerprints lie within a bit of it. So each
member is sent to itself and its 64 neighbours, and those that meet are linked without comparing pairs: linear, exact, and
no group has more than 65 members. Links become components by star steps; a class with a third of all rows is one row.

Defined results: a null text is an empty one; texts without words have fingerprint zero and are linked like any other;
one or two words are one shingle; rows repeated under one id, and different texts under one id, are rows of their own;
a component's id is its smallest id that is not null (null if there is none); an empty table gives no rows; texts of any
length are read whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import arrow_map, slices, utf8, written
from .components import components
from .neardup import together, whole_groups

WORDS = 3
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
DISTANCE = 2
BUCKET = 128
CHUNK = 1 << 16


def shingles(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, A-Z as a-z, each followed by a space, and begin, end and text of every shingle in it."""
    d = data[starts[0]:starts[-1]]
    starts = starts - starts[0]
    solid = ~((d == 32) | ((d >= 9) & (d <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = starts[(starts > 0) & (starts < len(d))]
    first[inner] |= solid[inner]
    byte = np.flatnonzero(solid)
    word = np.cumsum(first)[byte] - 1
    size = np.bincount(word, minlength=0)
    out = np.full(len(byte) + len(size), 32, np.uint8)
    low = d[byte]
    out[np.arange(len(byte)) + word] = np.where((low >= 65) & (low <= 90), low + 32, low)
    end = np.cumsum(size + 1) - 1
    begin = end - size
    offsets = np.searchsorted(np.flatnonzero(first), starts)
    n = np.diff(offsets)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][text]
    last = at + np.minimum(n, words)[text] - 1
    return out.tobytes(), begin[at], end[last], text


def fingerprints(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text of a buffer."""
    raw, begin, end, text = shingles(data, starts, words)
    ones, total = np.zeros((len(starts) - 1, 64), np.int64), np.bincount(text, minlength=len(starts) - 1)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(text), CHUNK):
        part = slice(k, k + CHUNK)
        h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin[part].tolist(), end[part].tolist(), strict=True)),
                        "<u8", len(text[part]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = text[part]
        head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        ones[of[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def printed(df: DataFrame, id_column: str, text_column: str, words: int = WORDS) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 1, 1 << 20):
            yield [part.column(0), pa.array(fingerprints(*utf8(part.column(1)), words).view(np.int64))]

    return arrow_map(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), run, f"id {kind}, fp long")


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fingerprint: which segment is taken as it is, its bits, and a Golay key of the next."""
    u = fp.view(np.uint64)
    parts = [((u >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        fuzzy, count = golay.fuzzy_keys(parts[(i + 1) % len(parts)])
        for j in range(golay.MOST_KEYS):
            has = np.flatnonzero(count > j)
            rows.append(has)
            keys.append((np.int64(i) << 34) | (exact[has] << golay.FREE) | fuzzy[has, j])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            row, key = bucket_keys(fp)
            yield [pa.array(key), pa.array(fp[row])]

    return arrow_map(classes.select("fp"), run, "key long, fp long")


def compared(buckets: DataFrame) -> DataFrame:
    """(a, b): within each bucket every member with the least one that links hold it together with."""
    rows = together(buckets.select("key", "fp"), "key")

    def run(batches):
        for t in whole_groups(batches):
            key, fp = t.column(0).to_numpy(), t.column(1).to_numpy()
            size = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
            left = np.repeat(np.cumsum(size), size) - np.arange(len(key))  # members from here to the bucket's end
            one, two = [], []
            for step in range(1, int(size.max())):
                at = np.flatnonzero(left > step)
                near = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= DISTANCE]
                one.append(near)
                two.append(near + step)
            if not one:
                continue
            one, two = np.concatenate(one), np.concatenate(two)
            name = np.arange(len(key))
            while True:
                old = name.copy()
                np.minimum.at(name, two, old[one])
                np.minimum.at(name, one, old[two])
                if (name == old).all():
                    break
            moved = np.flatnonzero(name < np.arange(len(key)))
            yield [pa.array(fp[moved]), pa.array(fp[name[moved]])]

    return arrow_map(rows, run, "a long, b long").distinct()


def by_midpoints(members: DataFrame) -> DataFrame:
    """(a, b): the same for fingerprints of crowded buckets, through the fingerprints within one bit."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    spread = members.select("fp", F.explode(F.array_append(flips, F.col("fp"))).alias("mid"))
    met = spread.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 members at most
    return met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()


def links(classes: DataFrame) -> DataFrame:
    """Stars over the classes (fp) that hang together; every link is a chain of them."""
    keys = written(keyed(classes), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("of"), "n")
    buckets = written(keys.join(sizes, F.col("key") == F.col("of")).drop("of"), "buckets")
    small = compared(buckets.where(F.col("n") <= BUCKET))
    crowded = buckets.where(F.col("n") > BUCKET).select("fp").distinct()
    return written(small.unionByName(by_midpoints(crowded)), "links")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    rows = written(printed(df, id_column, text_column, words), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    roots = components(links(classes)).select(F.col("v").alias("w"), "root")
    named = classes.join(roots, F.col("fp") == F.col("w"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    named = written(named.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("of"), "component_id"), "named")
    return rows.join(named, F.col("fp") == F.col("of")).select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
