"""Two-layer closed forms against a state vector."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.functions import layers as L
from phasegrid.plans.model import VariationalModel, average_gradient, average_losses, training_basis
from phasegrid.operators.scaling import Affine

GATES = {
    "rx": lambda t: np.array([[math.cos(t / 2), -1j * math.sin(t / 2)], [-1j * math.sin(t / 2), math.cos(t / 2)]]),
    "ry": lambda t: np.array([[math.cos(t / 2), -math.sin(t / 2)], [math.sin(t / 2), math.cos(t / 2)]], complex),
    "rz": lambda t: np.diag([np.exp(-1j * t / 2), np.exp(1j * t / 2)]),
}


def simulated(x, theta, rotation, entanglement, layers=2):
    """(<Z_q> of every qubit, probability of odd parity) of the circuit's state; qubit 0 is the low bit."""
    n = len(x)
    state = np.zeros(2**n, complex)
    state[0] = 1

    def turn(gate, q):
        nonlocal state
        cells = state.reshape([2] * n)
        state = np.moveaxis(np.tensordot(gate, cells, axes=(1, n - 1 - q)), 0, n - 1 - q).ravel()

    pairs = {(a, b) for a, s in enumerate(L.neighbours(n, entanglement)) for b in s if a < b}
    index = np.arange(2**n)
    for q, v in enumerate(x):
        turn(GATES["ry"](v), q)
    k = 0
    for _ in range(layers):
        for q in range(n):
            for name in (("rx", "ry", "rz") if rotation == "rxyz" else (rotation,)):
                turn(GATES[name](theta[k]), q)
                k += 1
        for a, b in pairs:
            state = np.where((index >> a & 1) & (index >> b & 1), -state, state)
    p = abs(state) ** 2
    odd = np.array([bin(i).count("1") % 2 for i in index])
    return [float(((1 - 2 * (index >> q & 1)) * p).sum()) for q in range(n)], float((odd * p).sum())


def row_of(spark, x, columns):
    df = spark.createDataFrame([tuple(map(float, x))], ", ".join(f"a{i} double" for i in range(len(x))))
    return list(df.select(*columns([F.col(f"a{i}") for i in range(len(x))])).first())


@pytest.mark.parametrize("entanglement", ["linear", "circular", "full"])
@pytest.mark.parametrize("rotation", ["ry", "rz", "rx", "rxyz"])
def test_expectations(spark, rotation, entanglement):
    rng = np.random.default_rng(5)
    for n in (1, 4):
        x, theta = rng.uniform(0, math.pi, n), rng.uniform(0, 2 * math.pi, 2 * n * (3 if rotation == "rxyz" else 1)).tolist()
        got = row_of(spark, x, lambda c: L.two_layer_z(c, theta, rotation, entanglement))
        assert np.allclose(got, simulated(x, theta, rotation, entanglement)[0], atol=1e-12)


@pytest.mark.parametrize("entanglement", ["linear", "circular", "full"])
def test_parity_loss_and_gradient(spark, entanglement):
    rng = np.random.default_rng(6)
    for n in (2, 4):
        x, theta = rng.uniform(-2, 2, n), rng.uniform(0, 2 * math.pi, 2 * n).tolist()
        want = simulated(x, theta, "ry", entanglement)[1]
        assert row_of(spark, x, lambda c: [L.two_layer_parity(c, theta, entanglement)]) == pytest.approx([want], abs=1e-12)
        scaler = Affine(tuple(f"a{i}" for i in range(n)), (0.0,) * n, (1.0,) * n)
        model = VariationalModel(scaler, tuple(theta), "rotation", "ry", "label", 2, entanglement)
        df = spark.createDataFrame([(*map(float, x), 1)], ", ".join(f"a{i} double" for i in range(n)) + ", label int")
        assert df.select(model.probability()).first()[0] == pytest.approx(want, abs=1e-12)
        basis = df.select("label", *[c.alias(k) for k, c in training_basis([F.col(f"a{i}") for i in range(n)], "rotation", "ry").items()])
        loss, *slope = average_gradient(basis, theta, "rotation", "ry", entanglement).first()
        assert loss == pytest.approx(-math.log(want), abs=1e-9)
        h = 1e-5
        moved = [[*theta[:i], theta[i] + w * h, *theta[i + 1 :]] for i in range(2 * n) for w in (1, -1)]
        losses = average_losses(basis, moved, "rotation", "ry", entanglement).first()
        assert slope == pytest.approx([(losses[2 * i] - losses[2 * i + 1]) / (2 * h) for i in range(2 * n)], abs=1e-5)


def test_layers_of_rz_change_nothing_and_deeper_ones_are_refused(spark):
    from phasegrid.plans.model import two_layers

    x = [0.3, 1.1, 2.0]
    assert simulated(x, [0.1] * 15, "rz", "full", 5)[1] == pytest.approx((1 - math.prod(map(math.cos, x))) / 2)
    assert not two_layers("rotation", "rz", 5, 3)
    for encoder, rotation, layers in (("rotation", "ry", 3), ("rotation", "rx", 2), ("angle", "ry", 2)):
        with pytest.raises(ValueError, match="no closed form"):
            two_layers(encoder, rotation, layers, 3)
    for n, entanglement in ((13, "linear"), (10, "full")):
        with pytest.raises(ValueError, match="more than"):
            two_layers("rotation", "ry", 2, n, entanglement)
    with pytest.raises(ValueError):
        L.neighbours(3, "star")


def test_two_layer_gradient_evaluates_the_parity_once(spark):
    """Slopes swap one factor in each product; the products are not evaluated again at shifted parameters."""
    n, theta = 4, [0.3 * i + 0.1 for i in range(8)]
    df = spark.createDataFrame([(0.5, 1.0, 1.5, 2.0, 1)], "a0 double, a1 double, a2 double, a3 double, label int")
    basis = df.select("label", *[c.alias(k) for k, c in training_basis([F.col(f"a{i}") for i in range(n)], "rotation", "ry").items()])
    size = lambda d: d._jdf.queryExecution().analyzed().toString().count(" * ")
    once = size(average_losses(basis, [theta], "rotation", "ry", "linear"))
    assert size(average_gradient(basis, theta, "rotation", "ry", "linear")) < 4 * once
