"""Multinomial logistic models of several feature draws, fitted together: one pass over the rows for each Newton step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTIAL = pa.schema([("place", pa.int64()), ("value", pa.float64())])


def _sums(batches: Iterator[pa.RecordBatch], mixes: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """(draw, gradient then curvature) of the log loss over the rows of a task; the last column is the class."""
    draws, classes, width = theta.shape
    size = classes * width
    out = np.zeros((draws, size + size * size))
    for batch in batches:
        cells = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        for start in range(0, len(cells), 16_384):
            part = cells[start : start + 16_384]
            given = (part[:, -1][:, None] == np.arange(classes)).astype(float)
            for t in range(draws):
                x = np.column_stack([part[:, :-1] @ mixes[t].T, np.ones(len(part))])
                score = x @ theta[t].T
                p = np.exp(score - score.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                out[t, :size] += ((p - given).T @ x).ravel()
                curve = np.zeros((classes, width, classes, width))
                for k in range(classes):
                    for j in range(k, classes):
                        weight = p[:, k] * ((1.0 if j == k else 0.0) - p[:, j])
                        curve[k, :, j] = x.T @ (x * weight[:, None])
                        curve[j, :, k] = curve[k, :, j].T
                out[t, size:] += curve.ravel()
    return out


def _step(rows: DataFrame, mixes: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The sums over all rows: each task sends one value a place, which Spark adds up."""

    def run(batches):
        value = _sums(batches, mixes, theta).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value)], schema=PARTIAL)

    draws, classes, width = theta.shape
    size = classes * width
    found = np.zeros(draws * (size + size * size))
    # as many rows as the models have gradient and curvature parts
    for place, value in rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value")).collect():
        found[place] = value
    return found.reshape(draws, -1)


def fit_draws(
    rows: DataFrame, columns: Sequence[str], label: str, mixes: np.ndarray, classes: int, max_iter: int = 25, tol: float = 1e-9,
) -> np.ndarray:
    """Weights (draw, class, feature and intercept) of the penalised models of all draws; C = 1, intercepts free.

    The features of draw t are ``mixes[t]`` times the row's ``columns``. Each step is one job over ``rows``, which the
    caller caches, for all draws at once; it ends when no draw moves. A step that would worsen no gradient is taken
    whole: the loss is convex and the penalty keeps its curvature from vanishing. Rows with a null or NaN among the
    columns, or without a class, count for nothing. The last class's intercept is 0, as only differences matter.
    """
    draws, features, _ = mixes.shape
    width = features + 1
    theta = np.zeros((draws, classes, width))
    free = np.ones((classes, width), bool)
    free[-1, -1] = False
    penalty = np.ones((classes, width))
    penalty[:, -1] = 0.0
    known = F.col(label).isNotNull()
    for c in columns:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    cells = rows.where(known).select(*[F.col(c).cast("double") for c in columns], F.col(label).cast("double"))
    size, open_ = classes * width, free.ravel()
    for _ in range(max_iter):
        sums = _step(cells, mixes, theta)
        moved = 0.0
        for t in range(draws):
            slope = sums[t, :size] + (penalty * theta[t]).ravel()
            curve = sums[t, size:].reshape(size, size) + np.diag(penalty.ravel())
            step = np.zeros(size)
            step[open_] = np.linalg.solve(curve[np.ix_(open_, open_)], slope[open_])
            theta[t] -= step.reshape(classes, width)
            moved = max(moved, float(np.abs(step).max()))
        if moved < tol:
            break
    return theta
