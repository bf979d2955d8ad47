"""DuckDB statements of the training queries: an optimiser's steps unrolled, two subqueries for each."""

from __future__ import annotations

from collections.abc import Sequence

from phasegrid.functions.hashing import draw_parameters, unit_from_text
from phasegrid.queries.registry import FEATURES, SEED, SQL_SCALED

N = len(FEATURES)
QUBITS = range(N)
CLIPPED = "greatest(least((1 - {}) / 2, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)"


def kept(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED ({body})"


def loss(p: str) -> str:
    return f"avg(-CASE WHEN label = 1 THEN ln({p}) ELSE ln(1 - {p}) END)"


def statement(parts: Sequence[str], last: str) -> str:
    return ",\n".join([SQL_SCALED, *parts]) + "\n" + last


def curve(parts: Sequence[str], names: Sequence[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS step, loss FROM {name}" for i, name in enumerate(names))
    return statement(parts, f"SELECT CAST(step AS INTEGER) AS step, round(loss, 6) + 0.0 AS loss FROM ({rows})")


def start_row() -> str:
    return ", ".join(f"{t!r}::DOUBLE AS t{q}" for q, t in enumerate(draw_parameters(N, SEED)))


def adam_parts(steps: int, own: str = "") -> list[str]:
    """Steps of the adaptive-gradient fit with the rotation encoder; names of the parts begin with ``own``."""
    x = ", ".join(f"x{q}" for q in QUBITS)
    z = [f"cos(x{q} + t{q})" for q in QUBITS]
    slope = "CASE WHEN label = 1 THEN -1 / p ELSE 1 / (1 - p) END"
    gradient = [
        f"avg(({slope}) * 0.5 * {' * '.join(z[j] for j in QUBITS if j != q)} * sin(x{q} + t{q})) AS g{q}" for q in QUBITS
    ]
    parts = [
        kept(own + "train", f"SELECT label, {x} FROM scaled WHERE NOT is_test"),
        kept(own + "s0", f"SELECT {start_row()}, " + ", ".join(f"0::DOUBLE AS m{q}, 0::DOUBLE AS v{q}" for q in QUBITS)),
    ]
    for k in range(1, steps + 1):
        rows = f"SELECT train.*, s.*, {CLIPPED.format(' * '.join(z))} AS p FROM {own}train AS train, {own}s{k - 1} AS s"
        parts.append(kept(f"{own}g{k}", f"SELECT {loss('p')} AS loss, {', '.join(gradient)} FROM ({rows})"))
        new = []
        for q in QUBITS:
            m, v = f"(0.9 * m{q} + 0.1 * g{q})", f"(0.999 * v{q} + 0.001 * g{q} * g{q})"
            step = f"0.1 * ({m} / {1 - 0.9**k!r}::DOUBLE) / (sqrt({v} / {1 - 0.999**k!r}::DOUBLE) + 1e-8)"
            new += [f"t{q} - {step} AS t{q}", f"{m} AS m{q}", f"{v} AS v{q}"]
        parts.append(kept(f"{own}s{k}", f"SELECT {', '.join(new)} FROM {own}s{k - 1}, {own}g{k}"))
    return parts


def adam_curve(steps: int) -> str:
    """Loss before each step."""
    return curve(adam_parts(steps), [f"g{k}" for k in range(1, steps + 1)])


def phase_sql() -> list[str]:
    phase = {(i, j): f"cos(2 * (pi() - x{i}) * (pi() - x{j}))" for i in QUBITS for j in QUBITS if i < j}
    return [" * ".join([f"cos(2 * x{q})", *[c for ij, c in phase.items() if q in ij]]) for q in QUBITS]


def spsa_parts(steps: int, own: str = "", rate: float = 0.6, width: float = 0.2) -> list[str]:
    """Steps of the perturbation fit with the phase encoder; names of the parts begin with ``own``."""
    parts = [
        kept(own + "train", "SELECT label, " + ", ".join(f"{e} AS h{q}" for q, e in enumerate(phase_sql())) + " FROM scaled WHERE NOT is_test"),
        kept(own + "s0", f"SELECT {start_row()}"),
    ]
    for k in range(steps):
        signs = [1.0 if unit_from_text(f"sign|{k}|{q}|{SEED}") < 0.5 else -1.0 for q in QUBITS]
        c = width / (k + 1) ** 0.101
        side = [
            CLIPPED.format(" * ".join(f"(-sin(t{q} + {way * c * s!r}::DOUBLE) * h{q})" for q, s in zip(QUBITS, signs)))
            for way in (1, -1)
        ]
        rows = f"SELECT label, {side[0]} AS up, {side[1]} AS down FROM {own}train, {own}s{k}"
        parts.append(kept(f"{own}e{k}", f"SELECT up, down, (up + down) / 2 AS loss FROM (SELECT {loss('up')} AS up, {loss('down')} AS down FROM ({rows}))"))
        gain = rate / (k + 1 + 0.1 * steps) ** 0.602
        new = [f"t{q} - {gain!r}::DOUBLE * (up - down) / {2 * c!r}::DOUBLE * {s} AS t{q}" for q, s in zip(QUBITS, signs)]
        parts.append(kept(f"{own}s{k + 1}", f"SELECT {', '.join(new)} FROM {own}s{k}, {own}e{k}"))
    return parts


def spsa_curve(steps: int) -> str:
    """Mean of the two losses of each step."""
    return curve(spsa_parts(steps), [f"e{k}" for k in range(steps)])


def newton_parts(steps: int = 8) -> list[str]:
    """``judged``: chances by a logistic model with a penalty of 1 / n on its weights, fitted by Newton steps."""
    every = range(N + 1)  # the last one is the intercept, whose input is 1
    x = [f"x{i}" for i in QUBITS] + ["1::DOUBLE"]
    chance = "1 / (1 + exp(-(" + " + ".join(f"w{i} * {x[i]}" for i in every) + ")))"
    parts = [
        kept("train", f"SELECT label, {', '.join(x[:N])} FROM scaled WHERE NOT is_test"),
        kept("w_0", "SELECT " + ", ".join(f"0::DOUBLE AS w{i}" for i in every)),
    ]
    upper = [(i, j) for i in every for j in every if i <= j]
    for k in range(1, steps + 1):
        rows = f"SELECT train.*, w.*, {chance} AS p FROM train, w_{k - 1} AS w"
        b = [f"avg((p - label) * {x[i]}){f' + any_value(w{i}) / count(*)' if i < N else ''} AS b{i}" for i in every]
        a = [f"avg(p * (1 - p) * {x[i]} * {x[j]}){' + 1.0 / count(*)' if i == j < N else ''} AS a{i}{j}" for i, j in upper]
        parts.append(kept(f"n{k}_0", f"SELECT {', '.join(a + b)} FROM ({rows})"))
        for c in QUBITS:  # elimination of a symmetric matrix, of which the upper half is kept
            a = [f"a{i}{j}" + (f" - a{c}{i} * a{c}{j} / a{c}{c}" if i > c else "") + f" AS a{i}{j}" for i, j in upper]
            b = [f"b{i}" + (f" - a{c}{i} * b{c} / a{c}{c}" if i > c else "") + f" AS b{i}" for i in every]
            parts.append(kept(f"n{k}_{c + 1}", f"SELECT {', '.join(a + b)} FROM n{k}_{c}"))
        back = [f"(b{i}{''.join(f' - a{i}{j} * d{j}' for j in every if j > i)}) / a{i}{i} AS d{i}" for i in reversed(every)]
        parts.append(kept(f"d_{k}", f"SELECT {', '.join(back)} FROM n{k}_{N}"))
        parts.append(kept(f"w_{k}", "SELECT " + ", ".join(f"w{i} - d{i} AS w{i}" for i in every) + f" FROM w_{k - 1}, d_{k}"))
    return [*parts, f"judged AS (SELECT label, is_test, {chance} AS p FROM scaled, w_{steps})"]


def newton_metrics() -> str:
    """Metrics of that model for each side of the split."""
    parts = [
        *newton_parts(),
        """cells AS (
  SELECT is_test, count(*) AS n_samples, count(*) FILTER (label = CAST(p > 0.5 AS INTEGER)) AS n_correct,
         count(*) FILTER (label = 0 AND p <= 0.5) AS tn, count(*) FILTER (label = 0 AND p > 0.5) AS fp,
         count(*) FILTER (label = 1 AND p <= 0.5) AS fn, count(*) FILTER (label = 1 AND p > 0.5) AS tp,
         round(""" + loss("p") + """, 6) + 0.0 AS log_loss
  FROM judged GROUP BY is_test)""",
    ]
    return statement(parts, """
SELECT *, n_correct / n_samples AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS "precision",
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
FROM cells""")


def parity_sql(t: Sequence[str]) -> str:
    """Odd parity behind two ry layers on a line, summed over every choice of qubits that read X; neighbours give 0."""
    products = []
    for chosen in range(2**N):
        picks = [q for q in QUBITS if chosen >> q & 1]
        if any(b - a == 1 for a, b in zip(picks, picks[1:])):
            continue
        factors = []
        for q in QUBITS:
            beside = (q - 1 in picks) + (q + 1 in picks)
            if q in picks:
                factors.append(f"(-sin({t[N + q]}) * sin(x{q} + {t[q]}))")
            else:
                factors.append(f"cos({t[N + q]})" + (f" * cos(x{q} + {t[q]})" if beside % 2 == 0 else ""))
        products.append(" * ".join(factors))
    return "((1 - (" + " + ".join(products) + ")) / 2)"


def two_layer_curve(steps: int) -> str:
    """Loss before each adaptive step of the two-layer fit; slopes by quarter turns of each parameter."""
    every = range(2 * N)
    names = [f"t{i}" for i in every]
    turned = lambda i, way: [f"({n} {way} pi() / 2)" if j == i else n for j, n in enumerate(names)]
    clipped = f"greatest(least({parity_sql(names)}, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)"
    start = ", ".join(f"{v!r}::DOUBLE AS t{i}, 0::DOUBLE AS m{i}, 0::DOUBLE AS v{i}" for i, v in enumerate(draw_parameters(2 * N, SEED)))
    parts = [kept("train", f"SELECT label, {', '.join(f'x{q}' for q in QUBITS)} FROM scaled WHERE NOT is_test"), kept("s0", f"SELECT {start}")]
    for k in range(1, steps + 1):
        slopes = ", ".join(f"{parity_sql(turned(i, '+'))} - {parity_sql(turned(i, '-'))} AS d{i}" for i in every)
        rows = f"SELECT label, {clipped} AS p, {slopes} FROM train, s{k - 1}"
        gradient = ", ".join(f"avg(CASE WHEN label = 1 THEN -0.5 / p ELSE 0.5 / (1 - p) END * d{i}) AS g{i}" for i in every)
        parts.append(kept(f"g{k}", f"SELECT {loss('p')} AS loss, {gradient} FROM ({rows})"))
        new = []
        for i in every:
            m, v = f"(0.9 * m{i} + 0.1 * g{i})", f"(0.999 * v{i} + 0.001 * g{i} * g{i})"
            step = f"0.1 * ({m} / {1 - 0.9**k!r}::DOUBLE) / (sqrt({v} / {1 - 0.999**k!r}::DOUBLE) + 1e-8)"
            new += [f"t{i} - {step} AS t{i}", f"{m} AS m{i}", f"{v} AS v{i}"]
        parts.append(kept(f"s{k}", f"SELECT {', '.join(new)} FROM s{k - 1}, g{k}"))
    return curve(parts, [f"g{k}" for k in range(1, steps + 1)])


def search_accuracies(trials: int, features: Sequence[str], steps: int = 8, test_size: float = 0.3) -> str:
    """Test accuracy of a three-class model for each draw, fitted by Newton steps whose equations are solved on lists."""
    classes, width = 3, N + 1
    unknown = [(k, f) for k in range(classes) for f in range(width) if (k, f) != (classes - 1, N)]
    x = [f"z{f}" for f in QUBITS] + ["1::DOUBLE"]
    score = [" + ".join(f"w[{u + 1}] * {x[f]}" for u, (c, f) in enumerate(unknown) if c == k) for k in range(classes)]
    draws = ", ".join("(" + ", ".join([str(t), *[f"{v!r}::DOUBLE" for v in draw_parameters(N, SEED, t)]]) + ")" for t in range(trials))
    scale = ", ".join(f"min({c}) AS a{i}, max({c}) AS b{i}" for i, c in enumerate(features))
    angles = ", ".join(f"({c} - a{i}) / CASE WHEN b{i} = a{i} THEN 1 ELSE b{i} - a{i} END * pi() AS x{i}" for i, c in enumerate(features))
    parts = [
        f"""flagged AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS flag,
             h / 4294967296.0 < {test_size} AS in_test FROM hashed)""",
        f"ranges AS (SELECT {scale} FROM flagged WHERE flag IS NOT NULL AND NOT in_test)",
        f"angles AS (SELECT flag, in_test, {angles} FROM flagged, ranges WHERE flag IS NOT NULL)",
        f"draws AS (SELECT * FROM (VALUES {draws}) AS d(trial, {', '.join(f't{q}' for q in QUBITS)}))",
        kept("drawn", f"SELECT trial, flag, in_test, {', '.join(f'cos(x{q} + t{q}) AS z{q}' for q in QUBITS)} FROM angles, draws"),
        kept("w0", f"SELECT trial, list_value({', '.join(['0::DOUBLE'] * len(unknown))}) AS w FROM draws"),
    ]
    for k in range(1, steps + 1):
        rows = f"SELECT d.*, w, {', '.join(f'exp({s}) AS e{c}' for c, s in enumerate(score))} FROM drawn d JOIN w{k - 1} USING (trial) WHERE NOT in_test"
        rows = f"SELECT *, {', '.join(f'e{c} / (e0 + e1 + e2) AS p{c}' for c in range(classes))} FROM ({rows})"
        slope = [f"sum((p{c} - (flag = {c})::INT) * {x[f]}) + {'any_value(w[%d])' % (u + 1) if f < N else '0'}" for u, (c, f) in enumerate(unknown)]
        sums = [f"sum(p{c} * ({int(c == d)} - p{d}) * {x[f]} * {x[g]}) + {int(u == v and f < N)} AS h{u}_{v}"
                for u, (c, f) in enumerate(unknown) for v, (d, g) in enumerate(unknown) if u <= v]
        parts.append(kept(f"h{k}", f"SELECT trial, any_value(w) AS w, {', '.join(f'{g} AS g{u}' for u, g in enumerate(slope))}, {', '.join(sums)} FROM ({rows}) GROUP BY trial"))
        matrix = ", ".join("[" + ", ".join([f"h{min(u, v)}_{max(u, v)}" for v in range(len(unknown))] + [f"g{u}"]) + "]" for u in range(len(unknown)))
        pivots = ", ".join(f"[[{u + 1}::DOUBLE]]" for u in range(len(unknown)))
        cleared = """list_reduce([m, PIVOTS], lambda a, c: list_transform(a, lambda row, i: CASE WHEN i = c[1][1]::INT
            THEN list_transform(row, lambda v: v / row[c[1][1]::INT])
            ELSE list_transform(row, lambda v, j: v - row[c[1][1]::INT] * a[c[1][1]::INT][j] / a[c[1][1]::INT][c[1][1]::INT]) END))""".replace("PIVOTS", pivots)
        parts.append(kept(f"w{k}", f"""SELECT trial, list_transform(w, lambda v, i: v - solved[i][{len(unknown) + 1}]) AS w
            FROM (SELECT trial, w, {cleared} AS solved FROM (SELECT trial, w, [{matrix}] AS m FROM h{k}))"""))
    parts += [
        f"judged AS (SELECT trial, flag, {', '.join(f'{s} AS l{c}' for c, s in enumerate(score))} FROM drawn JOIN w{steps} USING (trial) WHERE in_test)",
        """rated AS (SELECT trial, avg((flag = CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END)::INT) AS accuracy, count(*) AS n_test
             FROM judged GROUP BY trial)""",
    ]
    return statement(parts, f"""
SELECT trial::INTEGER AS trial, round(accuracy, 6) + 0.0 AS accuracy, trial = (SELECT min(trial) FROM rated WHERE accuracy = (SELECT max(accuracy) FROM rated)) AS is_best,
       n_test, {N}::INTEGER AS n_qubits, 'ry' AS ansatz FROM rated""")


def batch_metrics(steps: int) -> str:
    """Three runs over one split: the adaptive fit, an error, the perturbation fit; all beside one baseline."""
    chances = {
        "run-0": (CLIPPED.format(" * ".join(f"cos(x{q} + t{q})" for q in QUBITS)), f"a_s{steps}"),
        "run-2": (CLIPPED.format(" * ".join(f"(-sin(t{q}) * {h})" for q, h in enumerate(phase_sql()))), f"b_s{steps}"),
    }
    rows = " UNION ALL ".join(f"SELECT '{r}' AS run_id, label, {p} AS p FROM scaled, {s} WHERE is_test" for r, (p, s) in chances.items())
    hits = "count(*) FILTER (label = 1 AND p > 0.5)"
    parts = [
        *adam_parts(steps, "a_"), *spsa_parts(steps, "b_"), *newton_parts(),
        kept("chances", rows),
        f"""metrics AS (
  SELECT run_id, avg((label = (p > 0.5)::INT)::INT) AS accuracy,
         coalesce(2 * {hits} / nullif(2 * {hits} + count(*) FILTER (label <> (p > 0.5)::INT), 0), 0) AS f1
  FROM chances GROUP BY run_id)""",
        "by_score AS (SELECT run_id, p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM chances GROUP BY run_id, p)",
        "placed AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY run_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_score)",
        "areas AS (SELECT run_id, sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS roc_auc FROM placed GROUP BY run_id)",
        "sizes AS (SELECT count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test FROM scaled)",
        "base AS (SELECT avg((label = (p > 0.5)::INT)::INT) AS baseline_accuracy FROM judged WHERE is_test)",
        """named AS (SELECT * FROM (VALUES ('run-0', 'lines | rotation | ry | adam', 'adam'), ('run-2', 'lines | iqp | twolocal | cobyla', 'spsa')) AS v(run_id, run_label, optimizer_used))""",
    ]
    quoted = "chr(39) || {} || chr(39)"
    return statement(parts, f"""
SELECT run_id, run_label, 'ok' AS status, '' AS error, optimizer_used, n_train, n_test, {steps} AS epochs, round(accuracy, 6) + 0.0 AS accuracy,
       round(f1, 6) + 0.0 AS f1, round(roc_auc, 6) + 0.0 AS roc_auc, round(baseline_accuracy, 6) + 0.0 AS baseline_accuracy
FROM named JOIN metrics USING (run_id) JOIN areas USING (run_id), sizes, base
UNION ALL
SELECT 'run-1', 'orders | angle | realamplitudes | spsa', 'error',
       {quoted.format("'o_orderstatus'")} || ' must hold two classes, found [' || (SELECT string_agg({quoted.format('c')}, ', ' ORDER BY c) FROM (SELECT DISTINCT o_orderstatus AS c FROM orders)) || ']',
       '', 0, 0, 0, NULL, NULL, NULL, NULL""")
