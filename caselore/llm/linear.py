"""Linear models on sparse rows: dual coordinate descent for the hinge loss, a logistic curve for the margins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dual_descent(rows: list[np.ndarray], values: Callable[[int], np.ndarray], y: np.ndarray, size: int, cost: float = 1.0,
                 epochs: int = 10, seed: int = 0) -> np.ndarray:
    """Weights (the last one is the bias) that minimise |w|^2 / 2 + cost * sum of hinge losses.

    ``values(i)`` are the entries of row i. One dual variable a row, moved to its optimum while the others stand; rows in
    random order.
    """
    w, dual, rng = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([float(v @ v) + 1 for v in map(values, range(len(rows)))])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            v = values(i)
            margin = y[i] * (float(w[rows[i]] @ v) + w[size])
            new = min(max(dual[i] - (margin - 1) / square[i], 0.0), cost)
            step = (new - dual[i]) * y[i]
            if step:
                dual[i] = new
                w[rows[i]] += step * v
                w[size] += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def logistic_curve(margins: np.ndarray, positive: np.ndarray, steps: int = 50, level: bool = True) -> tuple[float, float]:
    """Slope and level of the curve that turns margins into probabilities, by damped Newton steps; ``level`` False keeps it 0."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - positive) * margins).sum() + 1e-3 * (a - 1), (p - positive).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-9]])
        if not level:
            d = np.array([g[0] / h[0, 0], 0.0])
        else:
            d = np.linalg.solve(h, g)
        d = np.clip(d, -1, 1)
        a, b = min(max(a - d[0], 0.05), 50.0), b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return float(a), float(b)


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of an Arrow column, as slices of one flat array."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]


def in_one_task(sample: DataFrame) -> DataFrame:
    """A bounded sample in one partition, in a fixed order: its fit is one task, repeated as it was if its executor is lost."""
    return sample.coalesce(1).sortWithinPartitions("id")


def labelled_sample(df: DataFrame, labels: DataFrame, rows: int, id_column: str, text_column: str, columns: list[str]) -> DataFrame:
    """About ``rows`` labelled texts (all, if there are fewer), chosen by the hash of their id; never more than twice as many.

    The chosen labels are few by construction, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col("label_id").isNotNull()).dropDuplicates(["label_id"])
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("label_id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * rows)
    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    return joined.select("id", "text", *columns).limit(2 * rows)
