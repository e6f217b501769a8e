"""Near-duplicate documents by a chosen-path set similarity join over min-wise sketches.

Texts with equal shingle sets become one class first. Classes then branch down independent trees: a node picks one or
two of the 64 sketch slots (4/3 on average, the inverse of the similarity threshold) and every class in it goes to the
children named by its values there. Branching stops at nodes of at most ``SMALL`` classes, which are compared
exhaustively: sketches first, then every surviving group on its full shingle sets. A pair at the threshold misses all
twelve trees with a chance of 2e-10 in the first level; if all the values it shares are hot, so that it can only meet deep
down, with 8e-4 five levels down, 3e-3 at seven and 1.2e-2 at ten. At 80 % it is 8e-4 at eleven levels.

A node that keeps almost all classes of its parent is a large group of near copies which no branching can divide. Its
classes are dealt into blocks, and a few pivots of the node join every block, so the group grows together in linear
work; afterwards whatever did not end up in the node's main component (its strays) is brought together with the whole
node, so no link is lost by the blocks. Small groups are compared block by block. In larger ones, families that share a
template but stay below the threshold among them, two documents meet only if they share a shingle outside the template
(``beside_core``), which is exact, so such a family costs work in proportion to its shingles.

Links: 100 * |A and B| >= 75 * |A or B| on the 64-bit hashes of the full sets. Inside a group a pair is not compared if
the two are already connected.

Defined results: a null text is an empty one; without words a document is its own component; documents of one to four
words have one shingle; rows repeated under one id are one document and share its verdict, but equal ids with
different texts are different documents; a component's id is its smallest id that is not null; a document without id is
kept only if no other member has one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import arrow_map, slices, utf8, written
from .components import components

ROOT_SLOTS = 16  # twelve trees, every third of which picks a second slot
SMALL = 96
PIVOTS = 16
STRAY = 128
PLAIN = 1024  # pairs of blocks of a group's strays and its members that are compared without looking at their shingles
TOKENS = 1 << 21
FILTER_WORDS = 1 << 20
DENSE = 0.72
DEPTH = 12
SURE = 34  # of 64 slots equal: a pair at the threshold has fewer with a chance of 4e-5
SIMILAR = 75


def sketched(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, text_hash, n_shingles, set_hash (128 bits) and sketch of every row."""
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).select(
        "id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches):
        for part in slices(batches, 2, 1 << 20):
            sets = S.shingle_sets(*utf8(part.column(2)))
            yield [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                   pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                   pa.array([S.sketch(s) if len(s) else None for s in sets], pa.list_(pa.int32()))]

    return arrow_map(rows, run, f"id {kind}, text_hash long, n_shingles long, set_hash binary, sketch array<int>")


def branched(sketches: DataFrame, rows: DataFrame) -> DataFrame:
    """The children (v, node, of) of ``rows`` (v, node, n): one slot of each node, and for every third node one more."""
    def slot(tag):
        return F.pmod(F.xxhash64("node", F.lit(tag)), F.lit(S.SLOTS)).cast("int")

    def child(tag):
        return F.xxhash64("node", slot(tag), F.get(F.col("sketch"), slot(tag)))

    second = F.pmod(F.xxhash64("node", F.lit("two")), F.lit(3)) == 0
    joined = rows.join(sketches.select(F.col("v").alias("w"), "sketch"), F.col("v") == F.col("w"))
    children = F.when(second, F.array_distinct(F.array(child("a"), child("b")))).otherwise(F.array(child("a")))
    return joined.select("v", F.explode(children).alias("node"), F.col("n").alias("of"))


def nodes(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(unit, v) of everything to compare, and (node, v) of the dense nodes if there are any."""
    sketches = classes.where("n_shingles > 0").select("v", "sketch")
    roots = F.array(*[F.xxhash64(F.lit(i), F.get(F.col("sketch"), F.lit(i))) for i in range(ROOT_SLOTS)])
    rows = sketches.select("v", F.explode(roots).alias("node"), F.lit(None).cast("long").alias("of"))
    small, dense = [], []
    for depth in range(1, DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node").alias("at"), "n")
        rows = written(rows.join(sizes, F.col("node") == F.col("at")).drop("at"), "level")
        small.append(rows.where(F.col("n") <= SMALL).select(F.col("node").alias("unit"), "v"))
        large = rows.where(F.col("n") > SMALL)
        stuck = (F.col("n") >= DENSE * F.col("of")) if depth < DEPTH else F.lit(True)
        stuck = F.coalesce(stuck, F.lit(False))
        left = large.agg(F.count_if(stuck).alias("stuck"), F.count_if(~stuck).alias("on")).first()
        if left["stuck"]:
            dense.append(large.where(stuck).select("node", "v", "n"))
        if not left["on"]:
            break
        rows = written(branched(sketches, large.where(~stuck)), "level")  # read twice: counted, then joined with the counts
    units = small[0]
    for more in small[1:]:
        units = units.unionByName(more)
    if not dense:
        return units, None
    crowded = dense[0]
    for more in dense[1:]:
        crowded = crowded.unionByName(more)
    crowded = written(crowded, "dense")
    blocks = F.ceil(F.col("n") / (SMALL - 2 * PIVOTS)).cast("int")
    pivot = F.pmod(F.xxhash64("v", "node", F.lit("pivot")), F.col("n")) < PIVOTS
    own = F.array(F.pmod(F.xxhash64("v", "node"), blocks).cast("int"))
    dealt = crowded.withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(own)))
    return units.unionByName(dealt.select(F.xxhash64("node", "block").alias("unit"), "v")), crowded.select("node", "v")


def whole_groups(batches):
    """Tables that hold whole groups of the first column, for input sorted by it; groups are small by construction."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        key = t.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def together(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def alike(units: DataFrame, classes: DataFrame) -> DataFrame:
    """(cluster, v, label): the parts of each unit that hang together by sketches, without pairs of one label."""
    rows = units.join(classes.select(F.col("v").alias("w"), "n_shingles", "sketch"), F.col("v") == F.col("w"))
    rows = together(rows.select("unit", "v", "label", "n_shingles", "sketch"), "unit")

    def run(batches):
        for t in whole_groups(batches):
            unit, v, label, n = (t.column(c).to_numpy() for c in range(4))
            flat = t.column(4).combine_chunks()
            flat = flat.flatten().to_numpy() if isinstance(flat, pa.Array) else flat.chunk(0).flatten().to_numpy()
            sketch = flat.reshape(len(v), S.SLOTS)
            begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            size = np.diff(np.r_[begin, len(unit)])
            a = begin[size == 2]
            b = a + 1
            fine = ((sketch[a] == sketch[b]).sum(1) >= SURE) & (label[a] != label[b])
            fine &= 100 * np.minimum(n[a], n[b]) >= SIMILAR * np.maximum(n[a], n[b])
            groups = [v[i:i + 2] for i in a[fine]]
            labels = [label[i:i + 2] for i in a[fine]]
            for i, k in zip(begin[size > 2], size[size > 2], strict=True):
                s, m, l = sketch[i:i + k], n[i:i + k], label[i:i + k]
                near = np.stack([(s == row).sum(1) for row in s]) >= SURE
                near &= 100 * np.minimum(m, m[:, None]) >= SIMILAR * np.maximum(m, m[:, None])
                near &= l != l[:, None]
                if not near.any():
                    continue
                np.fill_diagonal(near, True)
                name = np.arange(k)
                while True:
                    new = np.where(near, name, k).min(1)
                    if (new == name).all():
                        break
                    name = new
                for x in np.unique(name):
                    member = np.flatnonzero(name == x)
                    if len(member) > 1:
                        groups.append(v[i + member])
                        labels.append(l[member])
            if groups:
                keys = [xxhash.xxh3_64_intdigest(np.sort(g).tobytes()) - (1 << 63) for g in groups]
                yield [pa.array(np.repeat(np.array(keys, np.int64), [len(g) for g in groups])), pa.array(np.concatenate(groups)),
                       pa.array(np.concatenate(labels))]

    return arrow_map(rows, run, "cluster long, v long, label long").distinct()


def may_be_in(rows: DataFrame, wanted: DataFrame, key: list[str], wanted_key: list[str]) -> DataFrame:
    """``rows`` without most of those whose key is not in ``wanted``, before they are shuffled: a Bloom filter with one hash.

    It is a table of at most ``FILTER_WORDS`` words of 64 bits, whatever the data; more keys only let more rows through.
    """
    def places(h):
        return F.pmod(h, F.lit(FILTER_WORDS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")

    word, bit = places(F.xxhash64(*wanted_key))
    words = wanted.select(word.alias("word_"), bit.alias("bit_")).groupBy("word_").agg(
        F.expr("bit_or(shiftleft(1L, bit_))").alias("bits_"))
    word, bit = places(F.xxhash64(*key))
    return rows.join(F.broadcast(words), word == F.col("word_")).where(F.getbit("bits_", bit) == 1).drop("word_", "bits_")


def full_sets(df: DataFrame, classes: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(v, shingles) of the wanted classes, from the text of each class' first document."""
    rep = classes.join(wanted.select(F.col("v").alias("w")).distinct(), F.col("v") == F.col("w")).select(
        "v", F.col("first.id").alias("rep"), F.col("first.text_hash").alias("rep_hash"))
    texts = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))
    rep = written(rep, "wanted")
    texts = may_be_in(texts, rep, ["id", "text_hash"], ["rep", "rep_hash"])
    rows = texts.join(rep, F.col("id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
    rows = rows.dropDuplicates(["id", "text_hash"]).select("v", "text")

    def run(batches):
        for part in slices(batches, 1, 1 << 20):
            sets = S.shingle_sets(*utf8(part.column(1)))
            yield [part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())]

    return arrow_map(rows, run, "v long, shingles binary")


def stars(v: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """Each member with the least member of the same name."""
    out = []
    for x in np.unique(names):
        member = np.sort(v[names == x])
        out += [(m, member[0]) for m in member[1:]]
    return out


def joined_names(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Numbers of the parts that the links and the common labels of a cluster hold together."""
    names = np.unique(label, return_inverse=True)[1].reshape(-1)
    size = np.array([len(x) for x in sets], np.int64)
    if len(sets) <= 3 or size.sum() > TOKENS:
        for x in range(1, len(sets)):
            for y in range(x):
                if names[x] == names[y] or 100 * min(size[x], size[y]) < SIMILAR * max(size[x], size[y]):
                    continue
                both = S.shared(sets[x], sets[y])
                if 100 * both >= SIMILAR * (size[x] + size[y] - both):
                    names = np.where(names == names[x], names[y], names)
        return names
    token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    token = token.reshape(-1)
    both = np.full((len(sets), len(sets)), int((n == len(sets)).sum()), np.int64)
    some = (n > 1) & (n < len(sets))  # the others are in one set only, or in all of them
    place, owner = np.cumsum(some) - 1, np.repeat(np.arange(len(sets)), size)
    owner, place = owner[some[token]], place[token[some[token]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for a in range(0, int(some.sum()), 16384):
        i, j = np.searchsorted(place, [a, a + 16384])
        held = np.zeros((len(sets), 16384), np.float32)
        held[owner[i:j], place[i:j] - a] = 1
        both += (held @ held.T).astype(np.int64)
    near = (100 * both >= SIMILAR * (size + size[:, None] - both)) | (names == names[:, None])
    while True:
        new = np.where(near, names, len(sets)).min(1)
        if (new == names).all():
            return names
        names = new


def linked(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): stars over the parts of each cluster that its links, checked on full sets, hold together.

    Members of one label count as connected from the start.
    """
    rows = clusters.join(sets.select(F.col("v").alias("w"), "shingles"), F.col("v") == F.col("w"))
    rows = together(rows.select("cluster", "v", "label", "shingles"), "cluster")

    def run(batches):
        for t in whole_groups(batches):
            cluster, v, label = (t.column(c).to_numpy() for c in range(3))
            begin = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
            found = []
            for i, k in zip(begin, np.diff(np.r_[begin, len(cluster)]), strict=True):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(3).slice(i, k)]
                names = joined_names(sets, label[i:i + k])
                if len(np.unique(names)) < len(np.unique(label[i:i + k])):
                    found += stars(v[i:i + k], names)
            if found:
                pairs = np.array(found, np.int64)
                yield [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]

    return arrow_map(rows, run, "a long, b long")


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    of = roots.select(F.col("v").alias("w"), "root")
    return rows.join(of, F.col("v") == F.col("w"), "left").withColumn("label", F.coalesce("root", "v")).drop("w", "root")


def blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Units (unit, v, label) of bounded size in which all rows of ``left`` meet all of ``right`` (main, v, label) of their group."""
    sides = []
    for rows, name in ((left, "o"), (right, "b")):
        sizes = rows.groupBy("main").agg(F.ceil(F.count("*") / STRAY).cast("int").alias(name + "_blocks"))
        sides.append((rows, sizes, name))
    sizes = sides[0][1].join(sides[1][1], "main").withColumnRenamed("main", "of")
    out = []
    for (rows, _, own), other in zip(sides, ("b", "o"), strict=True):
        rows = rows.join(sizes, F.col("main") == F.col("of"))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("v", "main"), F.col(own + "_blocks")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(other + "_blocks") - 1)))
        out.append(rows.select(F.xxhash64("main", "o", "b", F.lit("stray")).alias("unit"), "v", "label"))
    return out[0].unionByName(out[1]).distinct()


def beside_core(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Units for ``rows`` (main, v, label, n) with ``sets`` (v, shingles), whose strays are too many to compare by blocks.

    The core of a group is what at least half of its members hold. Two sets of a and b shingles, c and d of them in the
    core, link only if they share 3/7 (a + b) - min(c, d) or more outside it. Where c < 6/7 a and d < 6/7 b that is at
    least (6/7 a - c) / 2 and as much for b, which is above zero: they have one of the rarest shingles outside the core in
    common, of which each set needs to show all but that many less one. Sets with more than 6/7 in the core may link by the core
    alone; they meet all strays, and the strays among them all members, by blocks.
    """
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                for a in range(0, len(one), 1 << 16):
                    part = one[a:a + (1 << 16)]
                    yield [pa.array(np.full(len(part), batch.column(0)[i].as_py())), pa.array(np.full(len(part), batch.column(1)[i].as_py())),
                           pa.array(part)]

    texts = rows.select("main", F.col("v").alias("w")).join(sets, F.col("v") == F.col("w")).select("main", "v", "shingles")
    tokens = written(arrow_map(texts, run, "main long, v long, token long"), "tokens")
    held = tokens.groupBy("main", "token").agg(F.count("*").alias("held")).where("held > 1")
    sizes = rows.groupBy("main").agg(F.first("n").alias("n"))
    held = held.join(sizes, "main").select(F.col("main").alias("of"), F.col("token").alias("t"), "held",
                                           (2 * F.col("held") >= F.col("n")).alias("core"))
    common = written(tokens.join(held, (F.col("main") == F.col("of")) & (F.col("token") == F.col("t"))).select(
        "main", "v", "token", "held", "core"), "tokens")
    all_of = tokens.groupBy("main", "v").agg(F.count("*").alias("a"))
    core_of = common.groupBy("main", "v").agg(F.count_if("core").alias("c"), F.count_if(~F.col("core")).alias("rest"))
    sums = all_of.join(core_of, ["main", "v"], "left").na.fill(0, ["c", "rest"])
    sums = sums.withColumn("need", F.expr("(6 * a - 7 * c + 13) div 14")).select(
        F.col("main").alias("of"), F.col("v").alias("w"), (7 * F.col("c") >= 6 * F.col("a")).alias("light"),
        (F.col("rest") - F.col("need") + 1).alias("shown"))  # those held once come first and meet nobody
    of = (F.col("main") == F.col("of")) & (F.col("v") == F.col("w"))
    marked = written(rows.join(sums, of).drop("of", "w"), "marked")
    heavy = marked.where("not light").select(F.col("main").alias("of"), F.col("v").alias("w"), "label", "shown")
    order = Window.partitionBy("main", "v").orderBy("held", "token")
    shown = common.where("not core").join(heavy, of).withColumn("place", F.row_number().over(order)).where("place <= shown")
    shown = written(shown.select("main", "token", "v", "label"), "shown")
    meet = shown.groupBy("main", "token").agg(
        F.count("*").alias("m"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("who"), F.min("label").alias("x"), F.max("label").alias("y"))
    meet = meet.where("x <> y").groupBy("main", "m", "who").agg(F.min("token").alias("t")).select(  # equal members: one unit
        F.col("main").alias("of"), "t", "m")
    met = shown.join(meet, (F.col("main") == F.col("of")) & (F.col("token") == F.col("t")))
    met = written(met.select(F.xxhash64("main", "token").alias("main"), "v", "label", "m"), "met")
    few = met.where(F.col("m") <= STRAY).select(F.col("main").alias("unit"), "v", "label")
    many = met.where(F.col("m") > STRAY).drop("m")
    stray, light = marked.where("label <> main"), marked.where("light")
    return few.unionByName(blocks(many, many)).unionByName(blocks(stray, light)).unionByName(blocks(stray.where("light"), marked))


def strays(dense: DataFrame, roots: DataFrame, sets_of) -> DataFrame:
    """Units (unit, v, label) that bring all classes outside their dense node's main component together with the node.

    Nodes of different trees that have the same main component are taken together, so each comparison happens once.
    """
    rows = written(_labelled(dense, roots), "dense")
    sizes = rows.groupBy("node", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("node").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("labels"))
    main = main.where("labels > 1").select(F.col("node").alias("at"), "main")
    rows = written(rows.join(main, F.col("node") == F.col("at")).select("main", "v", "label").distinct(), "dense")
    sizes = rows.groupBy("main").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("main")).alias("others"))
    rows = rows.join(sizes.select(F.col("main").alias("of"), "n", "others"), F.col("main") == F.col("of")).drop("of")
    work = F.ceil(F.col("others") / STRAY) * F.ceil(F.col("n") / STRAY)
    rows = written(rows.withColumn("large", work > PLAIN), "dense")
    plain, large = rows.where("not large"), rows.where("large")
    units = blocks(plain.where("label <> main"), plain)
    if large.isEmpty():
        return units
    return units.unionByName(beside_core(large, sets_of(large)))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text_hash, n_shingles, component_id and ``kept`` of every row."""
    rows = written(sketched(df, id_column, text_column), "sketched")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    classes = rows.where("n_shingles > 0").groupBy("set_hash").agg(
        first, F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    units, dense = nodes(classes)
    clusters = written(alike(units.withColumn("label", F.col("v")), classes), "clusters")
    links = written(linked(clusters, full_sets(df, classes, clusters, id_column, text_column)), "links")
    roots = components(links)
    if dense is not None:
        units = strays(dense, roots, lambda rows: full_sets(df, classes, rows, id_column, text_column))
        clusters = written(alike(units, classes), "clusters")
        if not clusters.isEmpty():
            more = linked(clusters, full_sets(df, classes, clusters, id_column, text_column))
            roots = components(more.unionByName(roots.select(F.col("v").alias("a"), F.col("root").alias("b"))))
    labelled = _labelled(classes.select("v", "set_hash", F.col("first.id").alias("first_id")), roots)
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id")).select(F.col("label").alias("l"), "component_id")
    named = written(labelled.join(least, F.col("label") == F.col("l")).select(F.col("set_hash").alias("of"), "component_id"), "named")
    out = rows.drop("sketch").join(named, (F.col("set_hash") == F.col("of")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_column), "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.col("component_id").isNull()))
