"""Toxicity by a classifier chain: categories one after the other, each model also fed the earlier categories' probabilities.

Features are words (A-Z as a-z), their first 3 to 6 bytes, and word shapes, all as 64-bit hashes. For each category the
features that differ most between its texts and the others are kept, and a linear model is fitted by dual coordinate
descent. For training, the earlier probabilities come from models that did not see the row (out-of-fold: neither their
features nor their weights come from the row's fold), so later
models learn from probabilities as uncertain as they will meet; for scoring they come from the models of all rows.

``FIT_ROWS`` bounds the labelled sample (about 8,000 rows by hash of the id); each text is scored whole, in one pass.

Defined results: a null text is an empty one; a category without rows of both kinds has probability 0; rows without id
are scored; labels that are null in a category count as not in it; repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import linear
from .common import arrow_map, column, free_name, slices, utf8, written
from .shingles import BYTE, _POWERS, _mix, word_hashes

FIT_ROWS = 8_000
FOLDS = 5
KEPT = 3_000
CERTAIN = 4.0  # standard errors between the shares of a kept feature
HEADS = (3, 4, 5, 6)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes by word (0: none) and the text of each word."""
    data, starts = utf8(column)
    words, offsets = word_hashes(data, starts)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(offsets))
    d = data[starts[0]:starts[-1]]
    if not len(words):
        return np.zeros((len(HEADS) + 2, 0), np.uint64), owner
    solid = ~((d == 32) | ((d >= 9) & (d <= 13)))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    borders = starts[1:-1] - starts[0]
    inner = borders[(borders > 0) & (borders < len(d))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    size = end + 1 - begin
    upper = np.cumsum(np.r_[0, (d >= 65) & (d <= 90)])
    capitals = upper[end + 1] - upper[begin]
    low = np.where((d >= 65) & (d <= 90), d + 32, d).astype(np.uint8)
    letter = lambda x: (x >= 97) & (x <= 122) | (x >= 128)
    out = [_bare(low, begin, end, words, letter)]
    head = np.zeros(len(begin), np.uint64)
    for j in range(max(HEADS)):
        here = np.minimum(begin + j, len(d) - 1)
        head = head + BYTE[low[here]] * _POWERS[j]
        if j + 1 in HEADS:
            out.append(np.where(size > j, _mix(head + np.uint64(j + 1)), np.uint64(0)))
    again = np.r_[False, (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])]
    kind = np.where(letter(low[end]), 0, np.where((low[end] == 46) | (low[end] == 44), 1, 2))
    shape = (((capitals > 0).astype(np.int64) + (2 * capitals > size)) * 3 + kind) * 2 + again
    out.append(_mix((shape * 4 + np.minimum(size // 3, 3) + (1 << 40)).astype(np.uint64)))
    return np.stack(out), owner


def _bare(low, begin, end, words, letter):
    """Word hashes, without one mark at the word's end."""
    marked = (end > begin) & ~letter(low[end])
    if not marked.any():
        return words
    texts, at = low, np.flatnonzero(marked)
    size = end[at] - begin[at]
    flat = np.repeat(begin[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    place = flat - np.repeat(begin[at], size)
    longest = int(place.max()) + 1
    from .shingles import _powers

    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    out = words.copy()
    out[at] = _mix(np.add.reduceat(BYTE[texts[flat]] * powers[place], np.r_[0, np.cumsum(size)[:-1]]))
    return out


@dataclass
class Link:
    """One category's model: weights of its features, of the earlier probabilities, bias, and the logistic curve."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    slope: float
    level: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.level, -30, 30)))


@dataclass
class Chain:
    names: list[str]
    hashes: np.ndarray  # sorted
    links: list[Link | None]

    def score(self, column: pa.Array) -> np.ndarray:
        """Probabilities by text and category."""
        found, owner = features(column)
        n, m = len(column), len(self.hashes)
        at = np.minimum(np.searchsorted(self.hashes, found), max(m - 1, 0))
        row, word = np.nonzero(self.hashes[at] == found) if m else (np.zeros(0, int),) * 2
        pairs = np.unique(owner[word] * m + at[row, word]) if len(word) else np.zeros(0, np.int64)
        return self.chained(pairs // max(m, 1), pairs % max(m, 1), n)

    def chained(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.names)))
        for c, link in enumerate(self.links):
            if link is not None:
                margin = np.bincount(text, link.weights[feature], n) + out[:, :c] @ link.earlier + link.bias
                out[:, c] = link.probability(margin)
        return out


def _fit_link(rows, values, y, n_features, n_earlier):
    return linear.dual_descent(rows, values, np.where(y, 1.0, -1.0), n_features + n_earlier, cost=0.5)


def telling(sample: DataFrame, names: list[str]) -> list[list[np.ndarray]]:
    """For each category the hashes whose share differs between its texts and the others by more than ``CERTAIN`` standard
    errors, KEPT at most: those of all rows first, then for each fold those of the rows outside it. ``sample`` has found,
    marks and fold; the counting is done by Spark, only the kept ones come here.
    """
    every = range(len(names))
    totals = {r[0]: list(r[1:]) for r in sample.groupBy("fold").agg(
        F.count("*"), *[F.coalesce(F.sum(F.col("marks")[c]), F.lit(0)) for c in every]).collect()}
    whole = [sum(t[k] for t in totals.values()) for k in range(len(names) + 1)]
    each = sample.select("marks", "fold", F.explode("found").alias("hash")).groupBy("hash").agg(
        F.count("*").alias("n"), *[F.sum(F.col("marks")[c]).alias(f"n{c}") for c in every],
        *[F.count_if(F.col("fold") == f).alias(f"n_f{f}") for f in range(FOLDS)],
        *[F.sum(F.when(F.col("fold") == f, F.col("marks")[c]).otherwise(0)).alias(f"n{c}_f{f}") for f in range(FOLDS) for c in every],
    ).where("n >= 4")
    scores = []
    for f in (None, *range(FOLDS)):
        out = totals.get(f, [0] * (len(names) + 1))
        total, *positive = (w - o for w, o in zip(whole, out, strict=True))
        without = (lambda x: F.col(x)) if f is None else (lambda x, f=f: F.col(x) - F.col(f"{x}_f{f}"))
        n, share = without("n"), without("n") / max(total, 1)
        for c in every:
            expected = share * positive[c]
            error = F.sqrt(F.greatest(expected * (1 - share), F.lit(1e-9)) * (1 - positive[c] / max(total, 1)))
            z = F.abs(without(f"n{c}") - expected) / F.greatest(error, F.lit(0.5))
            scores.append(F.when(n >= 4, z).otherwise(0.0).alias(f"z{len(scores)}"))
    each = written(each.select("hash", *scores).where(" or ".join(f"z{k} >= {CERTAIN}" for k in range(len(scores)))), "telling")
    kept = [np.array([r[0] for r in each.where(f"z{k} >= {CERTAIN}").orderBy(F.desc(f"z{k}"), "hash").limit(KEPT).select("hash").collect()],
                     np.int64).view(np.uint64) for k in range(len(scores))]
    return [kept[k:k + len(names)] for k in range(0, len(kept), len(names))]


def places(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of a text's hashes in the sorted ``hashes``, those that are there."""
    if not len(hashes):
        return np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    return at[hashes[at] == found].astype(np.int32)


def fit_rows(index: list[np.ndarray], y: np.ndarray, names: list[str], hashes: np.ndarray, kept: list[list[np.ndarray]],
             fold: np.ndarray) -> Chain:
    """``index``: the places of each text's features in ``hashes``; ``y``: 0/1 by text and category; ``kept``: hashes by category
    of all rows, then of the rows outside each fold; ``fold``: the fold of each text."""
    rows = index
    fine = [len(rows) > 0 and 0 < y[:, c].sum() < len(rows) for c in range(len(names))]
    m = len(hashes)
    earlier, links = np.zeros((len(rows), 0)), []
    for c in range(len(names)):
        if not fine[c]:
            links.append(None)
            earlier = np.hstack([earlier, np.zeros((len(rows), 1))])
            continue

        def chosen(hashes_of, texts, c=c):
            """Features and values of the given texts, the earlier probabilities behind their own hashes."""
            own = np.isin(hashes, hashes_of)
            x = [np.r_[i[own[i]], np.arange(m, m + c, dtype=np.int32)] for i in (index[t] for t in texts)]
            return x, lambda k: np.r_[np.ones(len(x[k]) - c), earlier[texts[k]]]

        positive = y[:, c] == 1
        margins = np.zeros(len(rows))
        for f in range(FOLDS):
            seen, unseen = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(unseen) == 0 or positive[seen].all() or not positive[seen].any():
                continue
            w = _fit_link(*chosen(kept[1 + f][c], seen), positive[seen], m, c)
            x, values = chosen(kept[1 + f][c], unseen)
            margins[unseen] = [float(w[x[k]] @ values(k)) + w[-1] for k in range(len(unseen))]
        slope, level = linear.logistic_curve(margins, positive.astype(float))
        w = _fit_link(*chosen(kept[0][c], np.arange(len(rows))), positive, m, c)
        links.append(Link(w[:m], w[m:m + c], float(w[-1]), slope, level))
        unseen = links[-1].probability(margins)
        earlier = np.hstack([earlier, unseen[:, None]])
    return Chain(names, hashes, links)


def fit(df: DataFrame, labels: DataFrame, categories: dict[str, str], rows: int = FIT_ROWS, id_column: str = "doc_id",
        text_column: str = "text") -> Chain:
    """A chain over ``categories`` (name -> SQL condition over ``labels``), in their order."""
    names = list(categories)
    marked = labels.select(F.col(id_column).alias("label_id"), F.array(*[
        F.coalesce(F.expr(c).cast("int"), F.lit(0)) for c in categories.values()]).alias("marks"))
    sample = linear.labelled_sample(df, marked, rows, id_column, text_column, ["marks"])

    def run(batches):
        for part in slices(batches, 1, 1 << 20):
            found, owner = features(part.column(1))
            begin = np.searchsorted(owner, np.arange(part.num_rows + 1))
            sets = [np.unique(found[:, a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield [part.column(0), part.column(2), pa.array([s[s > 0].view(np.int64) for s in sets], pa.list_(pa.int64()))]

    kind = df.schema[id_column].dataType.simpleString()
    sample = written(arrow_map(sample, run, f"id {kind}, marks array<int>, found array<long>").withColumn(
        "fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "features")
    kept = telling(sample, names)
    hashes = np.unique(np.concatenate([k for of in kept for k in of]))

    def learn(batches):
        index, marks, folds = [], [], []
        for batch in batches:
            index += [places(x.view(np.uint64), hashes) for x in linear.lists(batch.column(2))]
            marks += batch.column(1).to_pylist()
            folds.append(batch.column(3).to_numpy())
        y = np.array(marks, np.int64).reshape(len(index), len(names))
        chain = fit_rows(index, y, names, hashes, kept, np.concatenate([np.zeros(0, np.int32), *folds]).astype(np.int64))
        for c, link in enumerate(chain.links):
            if link is not None:
                yield [pa.array([c], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (link.weights, link.earlier)],
                       *[pa.array([float(x)]) for x in (link.bias, link.slope, link.level)]]

    # One task, bounded by the sample; only the weights come here.
    got = {r.c: r for r in arrow_map(linear.in_one_task(sample), learn,
                                     "c int, weights binary, earlier binary, bias double, slope double, level double").collect()}
    links = [got.get(c) and Link(np.frombuffer(got[c].weights), np.frombuffer(got[c].earlier), got[c].bias, got[c].slope, got[c].level)
             for c in range(len(names))]
    return Chain(names, hashes, links)


def score(df: DataFrame, chain: Chain, text_column: str = "text", prefix: str = "p_") -> DataFrame:
    """The rows of ``df``, whatever their columns, with a probability for each category."""
    new = [prefix + n for n in chain.names]
    if set(new) & set(df.columns):
        raise ValueError(f"the table has one of the columns {new} already; choose another prefix")
    rows = df.select("*", F.coalesce(column(text_column), F.lit("")).alias(free_name("text_to_score", df)))
    last = len(df.columns)

    def run(batches):
        for part in slices(batches, last, 1 << 20):
            p = chain.score(part.column(last))
            yield [*part.columns[:last], *[pa.array(p[:, c]) for c in range(len(new))]]

    return arrow_map(rows, run, StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in new]]))
