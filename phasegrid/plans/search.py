"""Random-parameter search: features of each draw, a multinomial model on them, best draw by test accuracy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions.encoding import rotation_weights
from phasegrid.functions.hashing import draw_parameters, parameter_count
from phasegrid.functions.readout import argmax
from phasegrid.operators.scaling import fit_angle_scale
from phasegrid.operators.splitting import hash_split
from phasegrid.plans.model import training_basis
from phasegrid.plans.softmax import fit_draws
from phasegrid.plans.train import spread

SEARCH_SCHEMA = (
    "trial int, accuracy double, theta array<double>, is_best boolean, n_test bigint, n_qubits int, ansatz string"
)


def _predicted(mix: np.ndarray, weights: np.ndarray, basis: Sequence[str]) -> Column:
    """Class of a row from its basis columns; the features are sums of them, so a class score is one as well."""
    scores = []
    for row in weights:
        score = F.lit(float(row[-1]))
        for name, w in zip(basis, row[:-1] @ mix):
            score = score + F.col(name) * float(w)
        scores.append(score)
    return argmax(F.array(*scores))


def _mix(theta: Sequence[float], ansatz: str, basis: Sequence[str]) -> np.ndarray:
    """The expectations of a draw as sums over the basis columns c0.., s0.. (cosines and sines of the angles)."""
    out = np.zeros((len([b for b in basis if b[0] == "c"]), len(basis)))
    for q, weights in enumerate(rotation_weights(theta, ansatz)):
        for name, w in zip("cs", weights[0]):
            if w:
                out[q, basis.index(f"{name}{q}")] = w
    return out


def search_parameters(
    df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], trials: int = 10, ansatz: str = "ry",
    most_qubits: int | None = None, test_size: float = 0.3, seed: int = 42, max_iter: int = 25, method: str = "xxhash64",
) -> DataFrame:
    """(trial, accuracy, theta, is_best, n_test, n_qubits, ansatz), one row per draw.

    All features are used; a ``most_qubits`` smaller than their number raises. ``label`` holds classes 0..k-1; rows
    without one take no part. Angles are scaled with train-side statistics. The cosines and sines of the angles do not
    depend on the draw: they are cached once, all draws are fitted together by steps of one job each, and the test
    accuracies of all draws come from one aggregate at the end.
    """
    spark = df.sparkSession
    used = list(features)
    if most_qubits is not None and most_qubits < len(used):
        raise ValueError(f"{len(used)} features do not fit {most_qubits} qubits")
    split = hash_split(df.where(F.col(label).isNotNull()), key, test_size, seed, method)
    angles = fit_angle_scale(split.where(~F.col("is_test")), used).apply(split)
    columns = training_basis([F.col(c) for c in used], "rotation", ansatz)
    basis = list(columns)
    rows = spread(angles.select(*[c.alias(n) for n, c in columns.items()], F.col(label).cast("int").alias("label"), "is_test"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = rows.where(~F.col("is_test"))
        top = train.agg(F.max("label")).first()[0]
        draws = [draw_parameters(parameter_count(len(used), 1, ansatz), seed, t) for t in range(trials)]
        mixes = np.array([_mix(d, ansatz, basis) for d in draws])
        weights = fit_draws(train, basis, "label", mixes, (top or 0) + 1, max_iter)
        y = F.col("label")
        predictions = [_predicted(m, w, basis) for m, w in zip(mixes, weights)]
        hits = rows.where("is_test").agg(
            F.count(F.lit(1)).alias("n"), *[F.count_if(p == y).alias(f"t{i}") for i, p in enumerate(predictions)]
        ).first()
    finally:
        rows.unpersist()
    scores = [hits[f"t{i}"] / hits["n"] if hits["n"] else 0.0 for i in range(trials)]
    # only a strictly better draw replaces an earlier one
    best = scores.index(max(scores))
    out = [(i, s, draws[i], i == best, hits["n"], len(used), ansatz) for i, s in enumerate(scores)]
    return spark.createDataFrame(out, SEARCH_SCHEMA)
