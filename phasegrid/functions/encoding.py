"""Feature encoders and one-layer variational expectations as closed forms.

Qubit q is bit q counted from the low end, and takes feature q. ``x`` is always the list of angle
columns. The forms are products of sines and cosines, so they stay inside whole-stage codegen; the
parameters are literals, so Catalyst folds their sines and cosines away.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from phasegrid.functions.values import let, product, total

ROTATIONS = ("ry", "rz", "rx", "rxyz")
ENTANGLEMENTS = ("linear", "circular", "full")
ENCODINGS = ("angle", "amplitude", "basis", "zz")
PI = math.pi


def used_features(columns: Sequence, n_qubits: int) -> list:
    """Features beyond the qubit count are not encoded."""
    return list(columns[: min(len(columns), n_qubits)])


def row_angles(columns: Sequence[Column]) -> list[Column]:
    """Min-max to [0, pi] across the features of one row; a flat row gives zeros."""
    if len(columns) == 1:
        # one feature is its own minimum
        return [columns[0] * 0.0]
    low, high = F.least(*columns), F.greatest(*columns)
    width = F.when(high - low > 1e-12, high - low).otherwise(F.lit(1.0))
    return [(c - low) / width * PI for c in columns]


def row_angles_array(values: Column) -> Column:
    """``row_angles`` for a feature array of any length."""
    doubles = values.cast("array<double>")
    bounds = F.struct(doubles.alias("v"), F.array_min(doubles).alias("lo"), F.array_max(doubles).alias("hi"))

    def scale(b: Column) -> Column:
        width = F.when(b["hi"] - b["lo"] > 1e-12, b["hi"] - b["lo"]).otherwise(F.lit(1.0))
        return F.transform(b["v"], lambda v: (v - b["lo"]) / width * PI)

    return let(bounds, scale)


def amplitudes(values: Column, n_qubits: int) -> Column:
    """Real state vector: cut or zero-padded to 2**n, L2-normalised, zero vector to the first basis state."""
    size = 1 << n_qubits
    cut = F.slice(values.cast("array<double>"), 1, size)
    padded = F.concat(cut, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(cut)))
    ground = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1))

    def normalise(vector: Column) -> Column:
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v * v))
        return let(
            F.struct(vector.alias("v"), norm.alias("n")),
            lambda s: F.when(s["n"] < 1e-12, ground).otherwise(F.transform(s["v"], lambda v: v / s["n"])),
        )

    return let(padded, normalise)


def basis_bits(columns: Sequence[Column]) -> list[Column]:
    return [(c != 0).cast("int") for c in columns]


def bit_expectation(bit: Column) -> Column:
    return F.lit(1) - F.lit(2) * bit


def pair_interactions(x: Sequence[Column]) -> dict[tuple[int, int], Column]:
    """Interaction angle 2 x_i x_j for each i < j."""
    return {(i, j): x[i] * x[j] * 2.0 for i in range(len(x)) for j in range(i + 1, len(x))}


def map_phases(x: Sequence[Column]) -> tuple[list[Column], dict[tuple[int, int], Column]]:
    """Second-order feature-map phases: 2 x_i, and 2 (pi - x_i)(pi - x_j) for each i < j."""
    single = [c * 2.0 for c in x]
    pairs = {
        (i, j): (PI - x[i]) * (PI - x[j]) * 2.0 for i in range(len(x)) for j in range(i + 1, len(x))
    }
    return single, pairs


def phase_features(x: Sequence[Column]) -> list[Column]:
    """<X_q> after the second-order feature map: cos(2 x_q) times the cosines of q's pair phases."""
    single, pairs = map_phases(x)
    return [
        F.cos(single[q]) * product([F.cos(p) for ij, p in pairs.items() if q in ij])
        for q in range(len(x))
    ]


def rotation_weights(theta: Sequence[float], rotation: str) -> list[list[tuple[float, float]]]:
    """Per qubit, the weights (a, b) of <Z> = a cos(x) + b sin(x), then those of each own derivative.

    Controlled-Z entanglers commute with Z, so every entanglement pattern gives the same values.
    """
    if rotation not in ROTATIONS:
        raise ValueError(f"unknown rotation {rotation!r}; known: {ROTATIONS}")
    sin, cos = math.sin, math.cos
    if rotation == "ry":
        return [[(cos(t), -sin(t)), (-sin(t), -cos(t))] for t in theta]
    if rotation == "rz":
        return [[(1.0, 0.0), (0.0, 0.0)] for _ in theta]
    if rotation == "rx":
        return [[(cos(t), 0.0), (-sin(t), 0.0)] for t in theta]
    if len(theta) % 3:
        raise ValueError(f"{len(theta)} parameters are no whole number of rx, ry, rz triples")
    out = []
    for a, b in zip(theta[0::3], theta[1::3]):
        out.append([
            (cos(a) * cos(b), -sin(b)), (-sin(a) * cos(b), 0.0), (-cos(a) * sin(b), -cos(b)), (0.0, 0.0),
        ])
    return out


def weighted(cosine: Column, sine: Column | None, weights: tuple[float, float]) -> Column:
    """a cos(x) + b sin(x) with the zero terms left out."""
    a, b = weights
    terms = [c * w for c, w in ((cosine, a), (sine, b)) if w != 0.0]
    return total(terms) if terms else F.lit(0.0)


def variational_z(x: Sequence[Column], theta: Sequence[float], rotation: str = "ry") -> list[Column]:
    """<Z_q> after angle encoding and one variational layer."""
    if rotation == "ry":
        return [F.cos(c + t) for c, t in zip(x, theta, strict=True)]
    weights = rotation_weights(theta, rotation)
    return [weighted(F.cos(c), F.sin(c), w[0]) for c, w in zip(x, weights, strict=True)]


def pair_encoded_x(x: Sequence[Column]) -> list[Column]:
    """<X_q> after ry angles and controlled-rz pair interactions.

    The expectation is the real part of a product of one complex factor per other qubit. Kept in
    polar form (moduli multiply, arguments add), the expression grows linearly with the qubits.
    """
    out = []
    for q in range(len(x)):
        moduli, arguments = [], []
        for j in range(len(x)):
            if j == q:
                continue
            angle = x[j] * x[q] * 2.0
            if j < q:
                # control j, target q: cos^2(x_j/2) + sin^2(x_j/2) e^{i angle}
                up = (F.lit(1.0) - F.cos(x[j])) * 0.5
                re = F.lit(1.0) - up + up * F.cos(angle)
                im = up * F.sin(angle)
            else:
                # control q, target j: cos^2 e^{-i angle/2} + sin^2 e^{i angle/2}
                re = F.cos(angle * 0.5)
                im = -F.cos(x[j]) * F.sin(angle * 0.5)
            moduli.append(F.sqrt(re * re + im * im))
            arguments.append(F.atan2(im, re))
        out.append(F.sin(x[q]) * product(moduli) * F.cos(total(arguments)))
    return out


def variational_pair_z(x: Sequence[Column], theta: Sequence[float]) -> list[Column]:
    """<Z_q> after the pair-interaction encoding and one layer of ry rotations."""
    return [
        F.cos(c) * math.cos(t) - flip * math.sin(t)
        for c, t, flip in zip(x, theta, pair_encoded_x(x), strict=True)
    ]


def parity_probability(z: Sequence[Column]) -> Column:
    """Probability of odd parity over independent qubits: (1 - product of <Z_q>) / 2."""
    return (F.lit(1.0) - product(list(z))) * 0.5
