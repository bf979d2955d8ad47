"""Encoders and one-layer variational expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.functions import encoding as E
from phasegrid.functions.layers import two_layer_z
from phasegrid.functions.hashing import draw_parameters
from phasegrid.operators.scaling import fit_angle_scale
from phasegrid.queries.registry import (
    FEATURES, LINE_KEY, SQL_ANGLES, SQL_KEYS, SQL_SCALED, THETA, THETA_XYZ, feature_columns, line_scaler, named, query,
    rounded, split_lines, sql_rounded,
)
from phasegrid.sources.tables import table

_X = [f"x{i}" for i in range(4)]


def _angles(spark, folder):
    lines = table(spark, folder, "lineitem").select(*LINE_KEY, *FEATURES)
    return fit_angle_scale(lines, FEATURES).apply(lines)


@query("encode_angle", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
b AS (SELECT *, list_min(v) AS lo, list_max(v) AS hi FROM e),
a AS (SELECT vec_id, generate_subscripts(v, 1) AS pos, unnest(v) AS x, lo, CASE WHEN hi - lo > 1e-12 THEN hi - lo ELSE 1.0 END AS w FROM b)
SELECT vec_id, CAST(pos - 1 AS INTEGER) AS qubit, round((x - lo) / w * pi(), 6) + 0.0 AS angle,
       round(cos((x - lo) / w * pi()), 6) + 0.0 AS z FROM a""")
def encode_angle(spark, folder):
    vectors = table(spark, folder, "embeddings")
    long = vectors.select("vec_id", F.posexplode(E.row_angles_array(F.col("embedding"))).alias("qubit", "angle"))
    return rounded(long.withColumn("z", F.cos("angle")), ["angle", "z"])


@query("encode_amplitude", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
p AS (SELECT vec_id, unnest(range(128)) AS pos, v, norm FROM n)
SELECT vec_id, CAST(pos AS INTEGER) AS state,
       round(CASE WHEN norm < 1e-12 THEN (pos = 0)::INT ELSE coalesce(v[pos + 1], 0.0) / norm END, 6) + 0.0 AS amplitude FROM p""")
def encode_amplitude(spark, folder):
    # 64 values on 7 qubits: the upper half of the state is padding
    vectors = table(spark, folder, "embeddings")
    long = vectors.select("vec_id", F.posexplode(E.amplitudes(F.col("embedding"), 7)).alias("state", "amplitude"))
    return rounded(long, ["amplitude"])


@query("encode_basis", f"SELECT {SQL_KEYS}, " + ", ".join(
    f"CASE WHEN {c} <> 0 THEN 1 ELSE 0 END AS b{i}, CASE WHEN {c} <> 0 THEN -1 ELSE 1 END AS z{i}" for i, c in enumerate(FEATURES)
) + " FROM lineitem")
def encode_basis(spark, folder):
    bits = E.basis_bits(feature_columns())
    cells = [c for i, b in enumerate(bits) for c in (b.alias(f"b{i}"), E.bit_expectation(b).alias(f"z{i}"))]
    return table(spark, folder, "lineitem").select(*LINE_KEY, *cells)


@query("encode_pairs", SQL_ANGLES + f" SELECT {SQL_KEYS}, " + ", ".join(
    f"round(2 * x{i} * x{j}, 6) + 0.0 AS p{i}{j}" for i in range(4) for j in range(i + 1, 4)
) + " FROM angles")
def encode_pairs(spark, folder):
    pairs = E.pair_interactions(feature_columns())
    return rounded(
        _angles(spark, folder).select(*LINE_KEY, *[c.alias(f"p{i}{j}") for (i, j), c in pairs.items()]),
        [f"p{i}{j}" for i, j in pairs],
    )


def _sql_phase(q: int) -> str:
    rest = " * ".join(f"cos(2 * (pi() - x{q}) * (pi() - x{j}))" for j in range(4) if j != q)
    return f"cos(2 * x{q}) * {rest}"


@query("encode_phases", SQL_SCALED + f" SELECT {SQL_KEYS}, {sql_rounded([_sql_phase(q) for q in range(4)], 'h', 4)} FROM scaled")
def encode_phases(spark, folder):
    lines = split_lines(spark, folder)
    scaled = line_scaler(lines).apply(lines)
    return scaled.select(*LINE_KEY, *named(E.phase_features(feature_columns()), "h", 4))


@query("map_phases", SQL_SCALED + f" SELECT {SQL_KEYS}, {sql_rounded([f'2 * x{q}' for q in range(4)], 's', 4)}, " + ", ".join(
    f"round(2 * (pi() - x{i}) * (pi() - x{j}), 4) + 0.0 AS p{i}{j}" for i in range(4) for j in range(i + 1, 4)
) + " FROM scaled")
def map_phases(spark, folder):
    lines = split_lines(spark, folder)
    single, pairs = E.map_phases(feature_columns())
    out = line_scaler(lines).apply(lines).select(
        *LINE_KEY, *named(single, "s", 4), *[c.alias(f"p{i}{j}") for (i, j), c in pairs.items()]
    )
    return rounded(out, [f"p{i}{j}" for i, j in pairs], 4)


def _variational(rotation: str, theta):
    def run(spark, folder):
        z = E.variational_z(feature_columns(), theta, rotation)
        return _angles(spark, folder).select(*LINE_KEY, *named(z, "z"))

    return run


_SQL_Z = {
    "ry": [f"cos(x{q} + {THETA[q]})" for q in range(4)],
    "rz": [f"cos(x{q})" for q in range(4)],
    "rx": [f"cos(x{q}) * cos({THETA[q]})" for q in range(4)],
    "rxyz": [
        f"cos(x{q}) * cos({THETA_XYZ[3 * q]}) * cos({THETA_XYZ[3 * q + 1]}) - sin(x{q}) * sin({THETA_XYZ[3 * q + 1]})"
        for q in range(4)
    ],
}
for _rotation, _sql in _SQL_Z.items():
    query(f"variational_{_rotation}", SQL_ANGLES + f" SELECT {SQL_KEYS}, {sql_rounded(_sql, 'z')} FROM angles")(
        _variational(_rotation, THETA_XYZ if _rotation == "rxyz" else THETA)
    )


def _sql_pair_z() -> str:
    """Complex products multiplied out step by step (the operator works in polar form)."""
    steps, last = [], "angles"
    for q in range(4):
        others = [j for j in range(4) if j != q]
        factors = ", ".join(
            (
                f"pow(cos(x{j}/2), 2) + pow(sin(x{j}/2), 2) * cos(2*x{j}*x{q}) AS fr{q}{j}, pow(sin(x{j}/2), 2) * sin(2*x{j}*x{q}) AS fi{q}{j}"
                if j < q
                else f"cos(x{j}*x{q}) AS fr{q}{j}, (pow(sin(x{j}/2), 2) - pow(cos(x{j}/2), 2)) * sin(x{j}*x{q}) AS fi{q}{j}"
            )
            for j in others
        )
        steps.append(f"f{q} AS (SELECT *, {factors} FROM {last})")
        a, b, c = others
        steps.append(
            f"g{q} AS (SELECT *, fr{q}{a}*fr{q}{b} - fi{q}{a}*fi{q}{b} AS gr{q}, fr{q}{a}*fi{q}{b} + fi{q}{a}*fr{q}{b} AS gi{q} FROM f{q})"
        )
        steps.append(f"t{q} AS (SELECT *, sin(x{q}) * (gr{q}*fr{q}{c} - gi{q}*fi{q}{c}) AS flip{q} FROM g{q})")
        last = f"t{q}"
    z = [f"cos({THETA[q]}) * cos(x{q}) - sin({THETA[q]}) * flip{q}" for q in range(4)]
    return SQL_ANGLES + ", " + ", ".join(steps) + f" SELECT {SQL_KEYS}, {sql_rounded(z, 'z')} FROM {last}"


@query("variational_zz", _sql_pair_z())
def variational_zz(spark, folder):
    z = E.variational_pair_z(feature_columns(), THETA)
    return _angles(spark, folder).select(*LINE_KEY, *named(z, "z"))


_THETA_TWO = (*THETA, 0.9, 1.7, 0.3, 2.2)


def _sql_two_layers(circular: bool) -> str:
    z = []
    for q in range(4):
        near = {q - 1, q + 1} & set(range(4)) | ({(q + 3) % 4, (q + 1) % 4} if circular else set())
        rest = " * ".join(f"cos(x{j} + {THETA[j]})" for j in sorted(near))
        z.append(f"cos({_THETA_TWO[4 + q]}) * cos(x{q} + {THETA[q]}) - sin({_THETA_TWO[4 + q]}) * sin(x{q} + {THETA[q]}) * {rest}")
    return SQL_ANGLES + f" SELECT {SQL_KEYS}, {sql_rounded(z, 'z')} FROM angles"


def _two_layers(entanglement: str):
    def run(spark, folder):
        z = two_layer_z(feature_columns(), _THETA_TWO, "ry", entanglement)
        return _angles(spark, folder).select(*LINE_KEY, *named(z, "z"))

    return run


for _name in ("linear", "circular"):
    query(f"variational_two_layers_{_name}", _sql_two_layers(_name == "circular"))(_two_layers(_name))

_TRIALS = 5


def _sql_theta(trial: str, q: int) -> str:
    return f"2 * pi() * CAST('0x' || substr(md5({trial} || '|{q}|42'), 1, 8) AS BIGINT) / 4294967296.0"


@query("trial_expectations", SQL_ANGLES + """,
trials AS (SELECT unnest(range(5)) AS trial),
t AS (SELECT CAST(trial AS INTEGER) AS trial, """ + ", ".join(f"{_sql_theta('trial', q)} AS t{q}" for q in range(4)) + """ FROM trials)
SELECT trial, """ + ", ".join(
    f"round(t{q}, 6) + 0.0 AS theta{q}, round((SELECT avg(cos(x{q} + t{q})) FROM angles), 6) + 0.0 AS mean_z{q}" for q in range(4)
) + " FROM t")
def trial_expectations(spark, folder):
    """Mean expectation per qubit for each seeded draw: all draws in one aggregate."""
    draws = [draw_parameters(4, 42, t) for t in range(_TRIALS)]
    means = _angles(spark, folder).agg(*[
        F.avg(z).alias(f"m{t}_{q}")
        for t, theta in enumerate(draws)
        for q, z in enumerate(E.variational_z(feature_columns(), theta))
    ])
    rows = [
        F.struct(
            F.lit(t).alias("trial"),
            *[F.lit(round(draws[t][q], 6)).alias(f"theta{q}") for q in range(4)],
            *[F.col(f"m{t}_{q}").alias(f"mean_z{q}") for q in range(4)],
        )
        for t in range(_TRIALS)
    ]
    return rounded(means.select(F.inline(F.array(*rows))), [f"mean_z{q}" for q in range(4)])


