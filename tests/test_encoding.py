"""Closed forms against a small state vector (tests only)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.functions import encoding as E
from phasegrid.functions.hashing import check_parameters, draw_parameters, parameter_count, parameter_table
from phasegrid.plans.model import average_gradient, average_losses, training_basis

N = 4


def ry(t):
    return np.array([[math.cos(t / 2), -math.sin(t / 2)], [math.sin(t / 2), math.cos(t / 2)]], complex)


def rx(t):
    return np.array([[math.cos(t / 2), -1j * math.sin(t / 2)], [-1j * math.sin(t / 2), math.cos(t / 2)]])


def rz(t):
    return np.diag([np.exp(-0.5j * t), np.exp(0.5j * t)])


def turn(state, gate, q):
    state = state.reshape([2] * N)
    axis = N - 1 - q  # qubit 0 is the low bit
    return np.moveaxis(np.tensordot(gate, state, ([1], [axis])), 0, axis).reshape(-1)


def bit(q):
    return (np.arange(2**N) >> q) & 1


def controlled_rz(state, angle, control, target):
    return state * np.where(bit(control) == 1, np.exp(1j * angle * (bit(target) - 0.5)), 1)


def entangle(state, pattern):
    pairs = {"linear": [(q, q + 1) for q in range(N - 1)], "full": [(a, b) for a in range(N) for b in range(a + 1, N)]}
    pairs["circular"] = pairs["linear"] + [(N - 1, 0)]
    for a, b in pairs[pattern]:
        state = state * np.where(bit(a) & bit(b), -1, 1)
    return state


def start(x):
    state = np.zeros(2**N, complex)
    state[0] = 1
    for q in range(N):
        state = turn(state, ry(x[q]), q)
    return state


def layer(state, theta, rotation, pattern):
    for q in range(N):
        if rotation == "rxyz":
            for gate, t in zip((rx, ry, rz), theta[3 * q : 3 * q + 3]):
                state = turn(state, gate(t), q)
        else:
            state = turn(state, {"rx": rx, "ry": ry, "rz": rz}[rotation](theta[q]), q)
    return entangle(state, pattern)


def z_values(state):
    p = abs(state) ** 2
    return [float((p * (1 - 2 * bit(q))).sum()) for q in range(N)]


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(5).uniform(0, math.pi, (12, N))


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], ["id", *"abcd"])


def evaluate(frame, columns):
    rows = frame.select("id", *[c.alias(f"v{i}") for i, c in enumerate(columns)]).orderBy("id").collect()
    return np.array([r[1:] for r in rows])


@pytest.mark.parametrize("rotation", E.ROTATIONS)
@pytest.mark.parametrize("pattern", E.ENTANGLEMENTS)
def test_one_layer_expectations(frame, points, rotation, pattern):
    theta = draw_parameters(parameter_count(N, 1, rotation), 3)
    got = evaluate(frame, E.variational_z([F.col(c) for c in "abcd"], theta, rotation))
    want = np.array([z_values(layer(start(p), theta, rotation, pattern)) for p in points])
    assert np.abs(got).max() <= 1 + 1e-12
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_pair_encoding(frame, points):
    theta = draw_parameters(N, 9)
    got = evaluate(frame, E.variational_pair_z([F.col(c) for c in "abcd"], theta))
    want = []
    for p in points:
        state = start(p)
        for i in range(N):
            for j in range(i + 1, N):
                state = controlled_rz(state, 2 * p[i] * p[j], i, j)
        want.append(z_values(layer(state, theta, "ry", "linear")))
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_parity_probability(frame, points):
    theta = draw_parameters(N, 4)
    p = E.parity_probability(E.variational_z([F.col(c) for c in "abcd"], theta))
    got = evaluate(frame, [p])[:, 0]
    odd = sum(bit(q) for q in range(N)) % 2 == 1
    want = [(abs(layer(start(x), theta, "ry", "full")) ** 2)[odd].sum() for x in points]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_phase_features(frame, points):
    """Hadamards, then diagonal phases 2 x_i and 2 (pi - x_i)(pi - x_j) on the parity of each pair."""
    got = evaluate(frame, E.phase_features([F.col(c) for c in "abcd"]))
    for row, x in zip(got, points):
        angle = np.zeros(2**N)
        for i in range(N):
            angle += 2 * x[i] * bit(i)
            for j in range(i + 1, N):
                angle += 2 * (math.pi - x[i]) * (math.pi - x[j]) * (bit(i) ^ bit(j))
        state = np.exp(1j * angle) / 2 ** (N / 2)
        for q in range(N):
            flipped = state[np.arange(2**N) ^ (1 << q)]
            assert abs((state.conj() * flipped).sum().real - row[q]) < 1e-9


def test_amplitudes(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0, 1.0, 1.0, 9.0])], "id int, v array<double>")
    got = {r["id"]: r["a"] for r in rows.select("id", E.amplitudes(F.col("v"), 2).alias("a")).collect()}
    assert got == {0: [0.6, 0.8, 0.0, 0.0], 1: [1.0, 0.0, 0.0, 0.0], 2: [0.5, 0.5, 0.5, 0.5]}


def test_row_angles_flat_row(spark):
    rows = spark.createDataFrame([(2.0, 2.0, 2.0)], "a double, b double, c double")
    assert list(rows.select(*E.row_angles([F.col(c) for c in "abc"])).first()) == [0.0, 0.0, 0.0]
    arrays = spark.createDataFrame([([5.0],), ([1.0, 3.0],)], "v array<double>")
    assert [r[0] for r in arrays.select(E.row_angles_array(F.col("v"))).collect()] == [[0.0], [0.0, math.pi]]


def test_basis(spark):
    rows = spark.createDataFrame([(0.0, -2.0)], "a double, b double")
    bits = E.basis_bits([F.col("a"), F.col("b")])
    assert list(rows.select(*bits, *[E.bit_expectation(b) for b in bits]).first()) == [0, 1, 1, -1]


def test_parameters(spark):
    assert parameter_count(2, 1, "rxyz") == 6 and parameter_count(3, 2, "ry") == 6
    with pytest.raises(ValueError):
        check_parameters([0.0] * 999, 2)
    table = {(r["trial"], r["position"]): r["theta"] for r in parameter_table(spark, 3, 4, 42).collect()}
    for trial in range(3):
        np.testing.assert_allclose([table[trial, i] for i in range(4)], draw_parameters(4, 42, trial))
    assert len(E.used_features(list("abcdef"), 4)) == 4


@pytest.mark.parametrize("encoder,rotation", [("rotation", r) for r in E.ROTATIONS] + [("angle", "ry")])
def test_gradient_is_the_slope_of_the_loss(frame, encoder, rotation):
    basis = training_basis([F.col(c) for c in "abcd"], encoder, rotation)
    rows = frame.select((F.col("id") % 2).cast("int").alias("label"), *[c.alias(n) for n, c in basis.items()]).cache()
    theta = draw_parameters(parameter_count(N, 1, rotation), 8)
    row = average_gradient(rows, theta, encoder, rotation).first()
    step, shifted = 1e-6, []
    for i in range(len(theta)):
        for sign in (1, -1):
            moved = list(theta)
            moved[i] += sign * step
            shifted.append(moved)
    losses = average_losses(rows, [theta, *shifted], encoder, rotation).first()
    assert abs(losses[0] - row[0]) < 1e-12
    slopes = [(losses[1 + 2 * i] - losses[2 + 2 * i]) / (2 * step) for i in range(len(theta))]
    np.testing.assert_allclose(row[1:], slopes, atol=1e-4, rtol=1e-4)
