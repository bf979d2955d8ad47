"""Rules a run specification must meet, for one spec and for a table of specs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phasegrid.functions.encoding import ENCODINGS, ENTANGLEMENTS, ROTATIONS


def spec_rules() -> dict[str, Column]:
    """Rule name to a column that is true where the rule is broken (columns as in flattened documents)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    n = F.size("feature_columns")
    return {
        "no_path": blank("dataset_path"),
        "no_label": blank("label_column"),
        "no_features": n == 0,
        "no_qubits": F.col("num_qubits") < 1,
        "qubits_differ_from_features": (n > 0) & (F.col("num_qubits") != n),
        "no_layers": F.col("layers") < 1,
        "unknown_ansatz": ~F.col("ansatz").isin(*ROTATIONS),
        "unknown_entanglement": ~F.col("entanglement").isin(*ENTANGLEMENTS),
        "unknown_encoder": ~F.col("encoder").isin(*ENCODINGS, "iqp", "rotation"),
    }


def broken_rules() -> Column:
    """Names of the broken rules in rule order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in spec_rules().items()]))


def check_circuit(
    n_qubits: int = 4, layers: int = 2, ansatz: str = "ry", entanglement: str = "linear", encoding: str = "angle"
) -> None:
    """Raise on the first bad circuit setting."""
    for name, value in (("n_qubits", n_qubits), ("layers", layers)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ValueError(f"{name} is {value!r}, not a positive whole number")
    for name, value, known in (
        ("ansatz", ansatz, ROTATIONS), ("entanglement", entanglement, ENTANGLEMENTS), ("encoding", encoding, ENCODINGS)
    ):
        if value not in known:
            raise ValueError(f"{name} is {value!r}, not one of {known}")


def check_run(label: str, features: list[str], num_qubits: int | None = None) -> None:
    if not label:
        raise ValueError("the spec names no label column")
    if not features:
        raise ValueError("the spec names no feature columns")
    if num_qubits is not None and num_qubits != len(features):
        raise ValueError(f"{num_qubits} qubits for {len(features)} features; the numbers must agree")
