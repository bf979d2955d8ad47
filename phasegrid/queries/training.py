"""Training runs; their splits are by md5, so that SQL can repeat them."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from phasegrid.operators.metrics import binary_metrics
from phasegrid.plans import train as T
from phasegrid.plans.model import average_gradient, training_basis
from phasegrid.plans.search import search_parameters
from phasegrid.queries.registry import (
    FEATURES, LINE_KEY, SQL_SCALED, THETA, feature_columns, line_scaler, query, rounded, split_lines,
)
from phasegrid.queries.training_sql import adam_curve, batch_metrics, newton_metrics, search_accuracies, spsa_curve, two_layer_curve
from phasegrid.sources.catalog import Catalog, Dataset
from phasegrid.sources.tables import table


def _sql_gradient() -> str:
    z = [f"cos(x{q} + {THETA[q]})" for q in range(4)]
    slope = "CASE WHEN label = 1 THEN -1 / p ELSE 1 / (1 - p) END"
    parts = []
    for q in range(4):
        rest = " * ".join(z[j] for j in range(4) if j != q)
        parts.append(f"round(avg(({slope}) * 0.5 * {rest} * sin(x{q} + {THETA[q]})), 6) + 0.0 AS g{q}")
    return SQL_SCALED + f""",
clipped AS (SELECT *, greatest(least((1 - {' * '.join(z)}) / 2, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE) AS p FROM scaled WHERE NOT is_test)
SELECT round(avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) + 0.0 AS loss, {', '.join(parts)} FROM clipped"""


@query("variational_loss_gradient", _sql_gradient())
def variational_loss_gradient(spark, folder):
    """One optimiser step: loss and gradient of the variational model from a single aggregate."""
    lines = split_lines(spark, folder)
    train = line_scaler(lines).apply(lines.where(~F.col("is_test")))
    basis = train.select("label", *[c.alias(n) for n, c in training_basis(feature_columns(), "rotation", "ry").items()])
    return rounded(average_gradient(basis, THETA, "rotation", "ry"), ["loss", "g0", "g1", "g2", "g3"])


def _prepared(spark, folder) -> T.Prepared:
    return T.prepare(table(spark, folder, "lineitem"), FEATURES, "l_linestatus", LINE_KEY, method="md5")


@query("baseline_lr", newton_metrics())
def baseline_lr(spark, folder):
    """Logistic-regression baseline, metrics per side of the split."""
    prepared = _prepared(spark, folder)
    scaled = prepared.scaler.apply(prepared.rows)
    train = T.spread(scaled.where(~F.col("is_test")).drop("is_test")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = T.fit_baseline(train, FEATURES, train.count())
    finally:
        train.unpersist()
    scored = scaled.withColumn("p", model.probability()).withColumn("prediction", (F.col("p") > 0.5).cast("int"))
    return rounded(binary_metrics(scored, "label", "prediction", "p", ["is_test"]), ["log_loss"])


def _curve(spark, folder, optimizer: str, encoder: str, maxiter: int, layers: int = 1):
    prepared = _prepared(spark, folder)
    # the split column is dropped with the filter, so each key is hashed once
    train = T.training_table(prepared, encoder, "ry").where(~F.col("is_test")).drop("is_test").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit = T.fit_variational(prepared, train, encoder, "ry", optimizer, maxiter, layers=layers)
    finally:
        train.unpersist()
    rows = [(i, loss) for i, loss in enumerate(fit.losses)]
    return rounded(spark.createDataFrame(rows, "step int, loss double"), ["loss"])


@query("variational_fit", adam_curve(15))
def variational_fit(spark, folder):
    """Loss per step of the adaptive-gradient fit."""
    return _curve(spark, folder, "adam", "rotation", 15)


@query("variational_fit_two_layers", two_layer_curve(6))
def variational_fit_two_layers(spark, folder):
    """Loss per step of the adaptive-gradient fit of two entangled layers."""
    return _curve(spark, folder, "adam", "rotation", 6, layers=2)


@query("variational_fit_spsa", spsa_curve(15))
def variational_fit_spsa(spark, folder):
    """Loss per step of the perturbation fit on the phase encoder."""
    return _curve(spark, folder, "spsa", "angle", 15)


@query("param_search", search_accuracies(5, FEATURES))
def param_search(spark, folder):
    """Five seeded draws, each with a multinomial model on three return flags; rows with another flag take no part."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2)
    lines = table(spark, folder, "lineitem").withColumn("flag", flag)
    return rounded(search_parameters(lines, FEATURES, "flag", LINE_KEY, trials=5, method="md5"), ["accuracy"]).drop("theta")


def _catalog(folder: str) -> Catalog:
    catalog = Catalog()
    catalog.register(Dataset("lines", f"{folder}/lineitem.parquet", "l_linestatus", FEATURES))
    catalog.register(Dataset("orders", f"{folder}/orders.parquet", "o_orderstatus", ("o_totalprice",)))
    return catalog


@query("batch_runs", batch_metrics(8))
def batch_runs(spark, folder):
    """Three specs side by side; the second has a three-class label and becomes an error row."""
    key = {"key_columns": list(LINE_KEY), "split_hash": "md5"}
    specs = [
        {"dataset": {"name": "lines", **key}, "encoder": {"type": "rotation"}, "circuit": {"type": "ry"}, "optimizer": {"type": "adam", "maxiter": 8}},
        {"dataset": {"name": "orders"}, "encoder": {"type": "angle"}, "circuit": {"type": "realamplitudes"}, "optimizer": {"type": "spsa"}},
        {"dataset": {"name": "lines", **key}, "encoder": {"type": "iqp"}, "circuit": {"type": "twolocal"}, "optimizer": {"type": "cobyla", "maxiter": 8}},
    ]
    runs = T.run_batch(spark, specs, _catalog(folder))
    return rounded(runs.select(
        "run_id", "run_label", "status", "error", "optimizer_used", "n_train", "n_test", "epochs", "accuracy", "f1", "roc_auc",
        F.col("baseline.accuracy").alias("baseline_accuracy"),
    ).fillna({"error": "", "optimizer_used": "", "n_train": 0, "n_test": 0, "epochs": 0}), ["accuracy", "f1", "roc_auc", "baseline_accuracy"])
