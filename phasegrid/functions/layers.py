"""Closed forms of circuits with two variational layers: what the entangling gates between them add.

The first layer leaves a product state, one Bloch vector for each qubit. A controlled-Z between qubits turns the X and Y
of a qubit into themselves times the Z of its neighbours and leaves Z alone, so an observable behind the second layer is a
short sum of products of the first layer's expectations. Gates behind the last layer commute with what is measured.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from phasegrid.functions.values import product, total

#: Products in the parity of a two-layer circuit; 12 qubits in a line have 377, 9 that all touch have 257.
MOST_PRODUCTS, MOST_QUBITS = 400, 12


def neighbours(n: int, entanglement: str) -> list[set[int]]:
    """Qubits that share a controlled-Z with each qubit: ``linear``, ``circular`` or ``full``."""
    if entanglement == "full":
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    elif entanglement in ("linear", "circular"):
        pairs = [(a, a + 1) for a in range(n - 1)] + ([(n - 1, 0)] if entanglement == "circular" and n > 2 else [])
    else:
        raise ValueError(f"unknown entanglement {entanglement!r}")
    out: list[set[int]] = [set() for _ in range(n)]
    for a, b in pairs:
        out[a].add(b)
        out[b].add(a)
    return out


def _bloch(x: Column, theta: Sequence[float], rotation: str) -> tuple[Column, Column, Column]:
    """(<X>, <Y>, <Z>) of one qubit after the angle x and the first layer's rotation."""
    zero = F.lit(0.0)
    if rotation == "ry":
        return F.sin(x + theta[0]), zero, F.cos(x + theta[0])
    if rotation == "rz":
        return F.sin(x) * math.cos(theta[0]), F.sin(x) * math.sin(theta[0]), F.cos(x)
    tilt = theta[0]
    y, z = F.cos(x) * -math.sin(tilt), F.cos(x) * math.cos(tilt)
    if rotation == "rx":
        return F.sin(x), y, z
    b, c = theta[1:]
    across, z = F.sin(x) * math.cos(b) + z * math.sin(b), F.sin(x) * -math.sin(b) + z * math.cos(b)
    return across * math.cos(c) - y * math.sin(c), across * math.sin(c) + y * math.cos(c), z


def _read(theta: Sequence[float], rotation: str) -> tuple[float, float, float]:
    """Weights of X, Y and Z in the Z behind the second layer's rotation."""
    if rotation == "ry":
        return -math.sin(theta[0]), 0.0, math.cos(theta[0])
    if rotation == "rz":
        return 0.0, 0.0, 1.0
    a = theta[0]
    if rotation == "rx":
        return 0.0, math.sin(a), math.cos(a)
    b = theta[1]
    return -math.sin(b), math.cos(b) * math.sin(a), math.cos(b) * math.cos(a)


def two_layer_z(x: Sequence[Column], theta: Sequence[float], rotation: str = "ry", entanglement: str = "linear") -> list[Column]:
    """<Z_q> after angle encoding and two layers with entangling gates between them; ``theta`` layer by layer."""
    n, each = len(x), 3 if rotation == "rxyz" else 1
    if rotation not in ("ry", "rz", "rx", "rxyz"):
        raise ValueError(f"unknown rotation {rotation!r}")
    if len(theta) != 2 * n * each:
        raise ValueError(f"{2 * n * each} parameters needed, {len(theta)} given")
    part = lambda layer, q: list(theta[(layer * n + q) * each :][:each])
    state = [_bloch(c, part(0, q), rotation) for q, c in enumerate(x)]
    near, out = neighbours(n, entanglement), []
    for q in range(n):
        wx, wy, wz = _read(part(1, q), rotation)
        turned = total([v * w for v, w in zip(state[q][:2], (wx, wy)) if w != 0.0])
        out.append(state[q][2] * wz + turned * product([state[j][2] for j in sorted(near[q])]))
    return out


def parity_products(n: int, entanglement: str) -> list[tuple[int, list[str]]]:
    """(sign, ``x``, ``z`` or ``1`` for each qubit) per product of the ry parity.

    Each qubit reads X or Z of the first layer; S are those that read X. The gates give a sign for each edge within S,
    and every qubit a Z for each neighbour in S. A qubit of S with an odd number of them reads Y, whose expectation is 0
    in a state of real amplitudes, so only sets in which that number is even for all count: on a line those without
    neighbours. Of the others, a Z meets another one and cancels where the number is odd.
    """
    near = neighbours(n, entanglement)
    out: list[tuple[int, list[str]]] = []
    if n > MOST_QUBITS:
        raise ValueError(f"the parity of two layers over {n} qubits, more than {MOST_QUBITS}")
    for chosen in itertools.product((False, True), repeat=n):
        inside = [sum(chosen[j] for j in near[q]) for q in range(n)]
        if any(c and k % 2 for c, k in zip(chosen, inside)):
            continue
        edges = sum(k for c, k in zip(chosen, inside) if c) // 2
        out.append((-1 if edges % 2 else 1, ["x" if c else "1" if k % 2 else "z" for c, k in zip(chosen, inside)]))
    if len(out) > MOST_PRODUCTS:
        raise ValueError(f"the parity of two {entanglement} layers over {n} qubits has more than {MOST_PRODUCTS} products")
    return out


def two_layer_parity(x: Sequence[Column], theta: Sequence[float], entanglement: str = "linear") -> Column:
    """Probability of odd parity behind two ry layers, exact for the entangled circuit."""
    n = len(x)
    first, second = theta[:n], theta[n:]
    kinds = {
        "x": [F.sin(c + a) * -math.sin(b) for c, a, b in zip(x, first, second, strict=True)],
        "z": [F.cos(c + a) * math.cos(b) for c, a, b in zip(x, first, second, strict=True)],
        "1": [F.lit(math.cos(b)) for b in second],
    }
    terms = [product([kinds[k][q] for q, k in enumerate(p)]) * float(sign) for sign, p in parity_products(n, entanglement)]
    return (F.lit(1.0) - total(terms)) * 0.5


def two_layer_parity_sql(theta: Sequence[float], entanglement: str = "linear") -> str:
    """The same over columns c0.., s0.. (cosines and sines of the angles), as text for the optimiser's steps."""
    n = len(theta) // 2
    sin, cos = math.sin, math.cos
    kinds = {"x": [], "z": [], "1": []}
    for q, (a, b) in enumerate(zip(theta[:n], theta[n:])):
        kinds["x"].append(f"(s{q} * {-sin(b) * cos(a)!r}D + c{q} * {-sin(b) * sin(a)!r}D)")
        kinds["z"].append(f"(c{q} * {cos(b) * cos(a)!r}D - s{q} * {cos(b) * sin(a)!r}D)")
        kinds["1"].append(f"{cos(b)!r}D")
    terms = [" * ".join([f"{sign}D", *[kinds[k][q] for q, k in enumerate(p)]]) for sign, p in parity_products(n, entanglement)]
    return f"((1D - ({' + '.join(terms)})) * 0.5D)"


def _factors(a: float, b: float) -> dict[str, tuple[tuple[float, str | None], ...]]:
    """Each kind's factor and its slopes by a and by b, as a constant times u = s cos a + c sin a, v = c cos a - s sin a or 1."""
    sin, cos = math.sin, math.cos
    return {
        "x": ((-sin(b), "u"), (-sin(b), "v"), (-cos(b), "u")),
        "z": ((cos(b), "v"), (-cos(b), "u"), (-sin(b), "v")),
        "1": ((cos(b), None), (0.0, None), (-sin(b), None)),
    }


def two_layer_slopes_sql(theta: Sequence[float], entanglement: str = "linear") -> tuple[dict[str, str], list[str]]:
    """Columns u0.., v0.. to make once per row over c0.., s0.., and over them the slope of the signed sum of products in
    ``two_layer_parity_sql`` by each parameter, layer by layer: a parameter's slope swaps its qubit's factor for the
    factor's slope, so no product is evaluated again at shifted parameters."""
    n = len(theta) // 2
    first, second = theta[:n], theta[n:]
    columns = {}
    for q, a in enumerate(first):
        columns[f"u{q}"] = f"(s{q} * {math.cos(a)!r}D + c{q} * {math.sin(a)!r}D)"
        columns[f"v{q}"] = f"(c{q} * {math.cos(a)!r}D - s{q} * {math.sin(a)!r}D)"
    factors = [_factors(a, b) for a, b in zip(first, second, strict=True)]
    products = parity_products(n, entanglement)
    slopes = []
    for by in (1, 2):
        for q in range(n):
            terms = []
            for sign, kinds in products:
                chosen = [factors[j][k][by if j == q else 0] for j, k in enumerate(kinds)]
                coefficient = sign * math.prod(c for c, _ in chosen)
                if coefficient != 0.0:
                    terms.append(" * ".join([f"{coefficient!r}D", *[f"{name}{j}" for j, (_, name) in enumerate(chosen) if name]]))
            slopes.append(" + ".join(terms) if terms else "0D")
    return columns, slopes
