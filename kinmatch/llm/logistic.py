"""Logistic regression that is fitted inside one task.

Spark's own takes a job and two broadcasts for each step, and the driver 4 MB of its heap for each broadcast, which is more than
the work for a table that fits one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.core.session import cut, release

#: L2 term of the weights of standardized features.
L2 = 1e-3
#: Newton's steps, at most, and the size of a step that ends them.
STEPS, STILL = 100, 1e-10


@dataclass
class Model:
    """Log-odds: ``base`` and the ``weights`` of the features."""

    base: float
    weights: list[float]

    def column(self, cols: list[str]) -> Column:
        """Probability of a row with the features ``cols``."""
        odds = F.lit(self.base)
        for c, w in zip(cols, self.weights, strict=True):
            odds = odds + F.col(c) * w
        return 1 / (1 + F.exp(-odds))


def solve(x: np.ndarray, y: np.ndarray, l2: float = L2) -> Model | None:
    """The minimum of the mean logistic loss plus ``l2 / 2`` times the squares of the weights of standardized features (the base is free).

    Newton's steps, halved until the loss falls. A feature that is the same in all rows has no weight. None where ``y`` (0 or 1) is the same in all rows, or there are none.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    varies = sd > 1e-12
    a = np.ones((len(y), varies.sum() + 1))
    a[:, 1:] = (x[:, varies] - mean[varies]) / sd[varies]
    ridge = np.full(a.shape[1], l2)
    ridge[0] = 0
    loss = lambda b: np.mean(np.logaddexp(0, a @ b) - y * (a @ b)) + ridge @ (b * b) / 2
    b = np.zeros(a.shape[1])
    b[0] = np.log(y.mean() / (1 - y.mean()))
    last = loss(b)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(a @ b)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(ridge + 1e-12), a.T @ (p - y) / len(y) + ridge * b)
        while (now := loss(b - step)) > last and np.abs(step).max() > STILL:
            step = step / 2
        if now <= last:
            b, last = b - step, now
        if np.abs(step).max() <= STILL:
            break
    weights = np.zeros(len(sd))
    weights[varies] = b[1:] / sd[varies]
    return Model(float(b[0] - weights @ mean), weights.tolist())


def fit(rows: DataFrame, cols: list[str], label: str) -> Model | None:
    """``solve`` of the columns ``cols`` (none of them NULL) and ``label`` in one task, which must have room for all rows; only the weights reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        x, y = (np.concatenate([np.column_stack([b[c].to_numpy(zero_copy_only=False) for c in cs]) for b in got]) if got else np.zeros((0, len(cs))) for cs in (cols, [label]))
        if model := solve(x, y[:, 0]):
            yield pa.RecordBatch.from_arrays([pa.array([model.base]), pa.array([model.weights], pa.list_(pa.float64()))], ["base", "weights"])

    double = [F.col(c).cast("double").alias(c) for c in (*cols, label)]
    written = cut(rows.select(*double).coalesce(1).mapInArrow(work, "base double, weights array<double>"))
    found = written.first()
    release(written)
    return Model(found["base"], list(found["weights"])) if found else None
