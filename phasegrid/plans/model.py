"""The one-layer variational classifier and the linear baseline as column expressions.

The probability of class 1 is the odd-parity probability of one qubit per feature,
(1 - product of <Z_q>) / 2. With the ``rotation`` encoder that is the exact product circuit; with
the phase encoders (``angle``, ``basis``, ``iqp``) each qubit reads -sin(theta_q) times its phase
feature, a product-form model that leaves entangled ansatz layers out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions.encoding import (
    parity_probability, phase_features, rotation_weights, variational_z,
)
from phasegrid.functions.hashing import check_parameters, parameter_count
from phasegrid.functions.layers import parity_products, two_layer_parity, two_layer_parity_sql, two_layer_slopes_sql
from phasegrid.functions.readout import class_from_probability, confidence_band, risk_label
from phasegrid.operators.columns import cast_features
from phasegrid.operators.scaling import Affine

CLIP = 1e-15
PHASE_ENCODERS = ("angle", "basis", "iqp")
# Which one-qubit rotation a circuit name stands for (rz after ry leaves <Z> as it is).
CIRCUIT_ROTATION = {
    "realamplitudes": "ry", "efficientsu2": "ry", "twolocal": "ry",
    "ry": "ry", "rz": "rz", "rx": "rx", "rxyz": "rxyz",
}

MODEL_SCHEMA = (
    "features array<string>, encoder string, rotation string, theta array<double>, "
    "offset array<double>, divisor array<double>, label_column string, layers int, entanglement string, "
    "baseline struct<weights: array<double>, intercept: double>, spec string"
)


def check_encoder(encoder: str, rotation: str) -> None:
    if encoder not in ("rotation", *PHASE_ENCODERS):
        raise ValueError(f"unknown encoder {encoder!r}")
    if encoder != "rotation" and rotation != "ry":
        raise ValueError(f"phase encoders are read out through ry, not {rotation!r}")


def two_layers(encoder: str, rotation: str, layers: int, n: int, entanglement: str = "linear") -> bool:
    """Whether the parity of two entangled layers is meant; raises for depths that have no closed form here.

    Rotations about z commute with the readout and the gates, so their layers change nothing at any depth.
    """
    if layers == 1 or (encoder == "rotation" and rotation == "rz"):
        return False
    if encoder != "rotation" or rotation != "ry" or layers != 2:
        raise ValueError(f"{layers} layers of {rotation} behind the encoder {encoder!r} have no closed form here")
    parity_products(n, entanglement)
    return True


def expectations(features: Sequence[Column], theta: Sequence[float], encoder: str, rotation: str) -> list[Column]:
    """<Z_q> per qubit from scaled features."""
    check_encoder(encoder, rotation)
    if encoder == "rotation":
        return variational_z(features, theta, rotation)
    return [h * -math.sin(t) for h, t in zip(phase_features(features), theta, strict=True)]


def training_basis(features: Sequence[Column], encoder: str, rotation: str) -> dict[str, Column]:
    """The row values every optimiser step works on: c0.., s0.. (cosines and sines) or c0.. (phase features).

    They do not depend on the parameters, so they are computed once and cached; a step is then a
    polynomial in them, without a trigonometric call per row.
    """
    check_encoder(encoder, rotation)
    if encoder != "rotation":
        return {f"c{q}": h for q, h in enumerate(phase_features(features))}
    out = {f"c{q}": F.cos(x) for q, x in enumerate(features)}
    if rotation in ("ry", "rxyz"):
        out |= {f"s{q}": F.sin(x) for q, x in enumerate(features)}
    return out


def step_weights(theta: Sequence[float], encoder: str, rotation: str) -> list[list[tuple[float, float]]]:
    """Weights of <Z_q> and its derivatives over the columns of ``training_basis``."""
    if encoder == "rotation":
        return rotation_weights(theta, rotation)
    return [[(-math.sin(t), 0.0), (-math.cos(t), 0.0)] for t in theta]


@dataclass(frozen=True)
class VariationalModel:
    scaler: Affine
    theta: tuple[float, ...]
    encoder: str = "rotation"
    rotation: str = "ry"
    label_column: str = "label"
    layers: int = 1
    entanglement: str = "linear"

    @property
    def features(self) -> tuple[str, ...]:
        return self.scaler.columns

    def probability(self) -> Column:
        """Probability of class 1 from the raw (unscaled) feature columns."""
        check_parameters(self.theta, parameter_count(len(self.features), self.layers, self.rotation))
        scaled = list(self.scaler.expressions().values())
        return self.probability_of(scaled)

    def probability_of(self, scaled: Sequence[Column]) -> Column:
        """The same from columns that are scaled already."""
        if two_layers(self.encoder, self.rotation, self.layers, len(self.features), self.entanglement):
            return two_layer_parity(scaled, self.theta, self.entanglement)
        return parity_probability(expectations(scaled, self.theta[: parameter_count(len(self.features), 1, self.rotation)], self.encoder, self.rotation))

    def score(self, df: DataFrame, lenient: bool = False) -> DataFrame:
        """All input columns plus prediction, risk_label, probability_class1 and confidence.

        A projection: no shuffle, no key alignment, valid on a streaming table. Extra columns pass
        through; a missing feature raises before any job.
        """
        clean = cast_features(df, self.features, lenient)
        scored = clean.withColumn("__p", self.probability())
        p = F.col("__p")
        prediction = class_from_probability(p)
        return scored.withColumns({
            "prediction": prediction,
            "risk_label": F.when(p.isNotNull(), risk_label(prediction)),
            "probability_class1": F.round(p, 4),
            "confidence": confidence_band(p),
        }).drop("__p")

    def to_row(self) -> tuple:
        return (
            list(self.features), self.encoder, self.rotation, list(self.theta),
            list(self.scaler.offset), list(self.scaler.divisor), self.label_column, self.layers, self.entanglement,
        )

    @classmethod
    def from_row(cls, row) -> VariationalModel:
        scaler = Affine(tuple(row["features"]), tuple(row["offset"]), tuple(row["divisor"]))
        return cls(scaler, tuple(row["theta"]), row["encoder"], row["rotation"], row["label_column"], row["layers"] or 1, row["entanglement"] or "linear")


@dataclass(frozen=True)
class LinearModel:
    """Logistic model on scaled features."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def probability(self) -> Column:
        margin = F.lit(self.intercept)
        for c, w in zip(self.features, self.weights, strict=True):
            margin = margin + F.col(c) * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


# A step is written as SQL text: the expressions are rebuilt with new numbers at every step, and one
# parse is far cheaper than hundreds of Column calls.
def _weighted_sql(q: int, weights: tuple[float, float]) -> str:
    terms = [f"{name}{q} * {w!r}D" for name, w in zip("cs", weights) if w != 0.0]
    return f"({' + '.join(terms)})" if terms else "0D"


def _product_sql(factors: Sequence[str]) -> str:
    return " * ".join(factors) if factors else "1D"


def _parity_sql(values: Sequence[str]) -> str:
    """Null for a row with a missing feature: greatest and least would skip it and answer with a limit."""
    return _clipped_sql(f"((1D - {_product_sql(values)}) * 0.5D)")


def _clipped_sql(p: str) -> str:
    return f"CASE WHEN {p} IS NOT NULL AND NOT isnan({p}) THEN greatest(least({p}, 1D - {CLIP!r}D), {CLIP!r}D) END"


def _loss_sql(p: str) -> str:
    return f"avg(-ln(CASE WHEN label = 1 THEN {p} ELSE 1D - {p} END))"


def _chance_sql(theta: Sequence[float], encoder: str, rotation: str, deep: str | None) -> str:
    """Clipped probability of class 1 over the basis columns; ``deep`` is the entanglement of two layers."""
    if deep is not None:
        return _clipped_sql(two_layer_parity_sql(theta, deep))
    return _parity_sql([_weighted_sql(q, w[0]) for q, w in enumerate(step_weights(theta, encoder, rotation))])


def average_losses(
    basis: DataFrame, candidates: Sequence[Sequence[float]], encoder: str, rotation: str, deep: str | None = None
) -> DataFrame:
    """One row (loss0, loss1, ..): mean loss of each parameter vector, from one aggregate."""
    probabilities = [_chance_sql(t, encoder, rotation, deep) for t in candidates]
    rows = basis.selectExpr("label", *[f"{p} AS p{i}" for i, p in enumerate(probabilities)])
    return rows.selectExpr(*[f"{_loss_sql(f'p{i}')} AS loss{i}" for i in range(len(candidates))])


def _two_layer_gradient(basis: DataFrame, theta: Sequence[float], entanglement: str) -> DataFrame:
    """The same for two layers: each qubit's factors are made once per row, and a parameter's slope is the sum of
    products with that qubit's factor swapped for its slope."""
    columns, slopes = two_layer_slopes_sql(theta, entanglement)
    rows = basis.selectExpr(
        "label", f"{_chance_sql(theta, 'rotation', 'ry', entanglement)} AS p", *[f"{sql} AS {name}" for name, sql in columns.items()],
    )
    # d loss / d p, times the -1/2 of the parity probability
    by_p = "(CASE WHEN label = 1 THEN 0.5D / p ELSE -0.5D / (1D - p) END)"
    return rows.selectExpr(f"{_loss_sql('p')} AS loss", *[f"avg({by_p} * ({g})) AS g{i}" for i, g in enumerate(slopes)])


def average_gradient(basis: DataFrame, theta: Sequence[float], encoder: str, rotation: str, deep: str | None = None) -> DataFrame:
    """One row (loss, g0, g1, ..): mean loss and its gradient, from one aggregate."""
    if deep is not None:
        return _two_layer_gradient(basis, list(theta), deep)
    weights = step_weights(theta, encoder, rotation)
    n = len(weights)
    rows = basis.selectExpr("*", *[f"{_weighted_sql(q, w[0])} AS z{q}" for q, w in enumerate(weights)])
    rows = rows.selectExpr("*", f"{_parity_sql([f'z{q}' for q in range(n)])} AS p")
    # d loss / d p, times the -1/2 of the parity probability
    by_p = "(CASE WHEN label = 1 THEN 0.5D / p ELSE -0.5D / (1D - p) END)"
    slopes = [
        _product_sql([by_p, _weighted_sql(q, d), *[f"z{j}" for j in range(n) if j != q]])
        for q, w in enumerate(weights) for d in w[1:]
    ]
    return rows.selectExpr(f"{_loss_sql('p')} AS loss", *[f"avg({g}) AS g{i}" for i, g in enumerate(slopes)])
