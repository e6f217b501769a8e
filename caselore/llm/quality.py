"""Quality by naive-Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss fit.

Indicators are distinct byte pairs and triples and word shapes (``ngrams``). The ratio of an indicator is the log of how
often good and bad training texts have it; a text's features are the ratios of what it contains, scaled to length one,
so long and short texts weigh alike. The hinge loss is minimised by dual coordinate descent, and a logistic curve turns
margins into scores (0.5 at margin 0).

``FIT_ROWS`` bounds the labelled sample that ratios and weights are learned from (about 10,000 rows by hash of the id,
all if there are fewer); every text is scored whole, in one pass without a shuffle.

Defined results: a null text is scored as an empty one, by the bias; without training rows of both labels every score
is 0.5; rows without id are scored too; labels that are null, and labels repeated beyond one for an id, are not learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import linear
from .common import arrow_map, column, free_name, slices
from .ngrams import QUALITY_SIZE, quality_ngrams

FIT_ROWS = 10_000


@dataclass
class Model:
    ratios: np.ndarray  # float32, one for each indicator
    weights: np.ndarray  # float32, already times the ratios
    bias: float
    slope: float

    def score(self, index: np.ndarray) -> float:
        r = self.ratios[index]
        margin = float(self.weights[index].sum(dtype=np.float64)) / np.sqrt(float(r @ r) + 1) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin, -30, 30))))


def fit_rows(rows: list[np.ndarray], good: np.ndarray) -> Model | None:
    if len(rows) == 0 or good.all() or not good.any():
        return None
    counts = np.ones((2, QUALITY_SIZE))
    for x, g in zip(rows, good, strict=True):
        counts[int(g), x] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    lengths = np.array([np.sqrt(ratios[x] @ ratios[x] + 1) for x in rows])

    def values(i):  # worked out when they are needed: kept, they would be larger than the sample
        return ratios[rows[i]] / lengths[i]

    w = linear.dual_descent(rows, values, np.where(good, 1.0, -1.0), QUALITY_SIZE)
    margins = np.array([float(w[x] @ values(i)) + w[-1] for i, x in enumerate(rows)])
    slope, _ = linear.logistic_curve(margins, good.astype(float), level=False)
    return Model(ratios.astype(np.float32), (w[:-1] * ratios).astype(np.float32), float(w[-1]), slope)


def fit(df: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "quality") -> Model | None:
    """A model from the labels given (leave out what is held back). One task, bounded by the sample, turns its texts into
    weights; only these come to the driver."""
    labels = labels.select(F.col(id_column).alias("label_id"), F.col(label_column).cast("int").alias("good")).where("good in (0, 1)")
    sample = linear.labelled_sample(df, labels, rows, id_column, text_column, ["good"])

    def run(batches):
        for part in slices(batches, 1, 1 << 20):
            yield [part.column(0), part.column(2), pa.array([x for x in quality_ngrams(part.column(1))], pa.list_(pa.int32()))]

    found = arrow_map(sample, run, f"id {df.schema[id_column].dataType.simpleString()}, good int, found array<int>")

    def learn(batches):
        index, good = [], []
        for batch in batches:
            index += linear.lists(batch.column(2))
            good.append(batch.column(1).to_numpy() == 1)
        model = fit_rows(index, np.concatenate([np.zeros(0, bool), *good]))
        if model is not None:
            yield [pa.array([model.ratios.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()),
                   pa.array([model.bias]), pa.array([model.slope])]

    got = arrow_map(linear.in_one_task(found), learn, "ratios binary, weights binary, bias double, slope double").first()
    return got and Model(np.frombuffer(got.ratios, np.float32), np.frombuffer(got.weights, np.float32), got.bias, got.slope)


def score(df: DataFrame, model: Model | None, text_column: str = "text", name: str = "score") -> DataFrame:
    """The rows of ``df``, whatever their columns, with the score of their text in column ``name``."""
    if name in df.columns:
        raise ValueError(f"the table has a column {name} already; choose another name")
    rows = df.select("*", F.coalesce(column(text_column), F.lit("")).alias(free_name("text_to_score", df)))
    last = len(df.columns)

    def run(batches):
        for part in slices(batches, last, 1 << 20):
            found = [0.5] * part.num_rows if model is None else [model.score(x) for x in quality_ngrams(part.column(last))]
            yield [*part.columns[:last], pa.array(found, pa.float64())]

    return arrow_map(rows, run, StructType([*df.schema.fields, StructField(name, DoubleType())]))
