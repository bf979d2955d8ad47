"""Named datasets and components.

A catalog maps a short name to a path, a label and features; explicit fields of a spec override
them. Users register their own datasets; the three domain layouts below are known from the start
and need only the folder their files are in.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from phasegrid.operators.columns import require_columns
from phasegrid.operators.specs import check_run
from phasegrid.sources.csv import EmptyTable, read_csv, read_nonempty


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    label_column: str
    feature_columns: tuple[str, ...]
    domain: str = ""
    description: str = ""
    recommended: dict = field(default_factory=dict)
    schema: str = ""  # declared columns; what is not declared is read from the files


# File, label and feature names of the three domain layouts.
DOMAINS = {
    "finance": Dataset(
        "finance", "finance_portfolio_risk.csv", "risk_flag",
        ("market_volatility", "debt_ratio", "liquidity_ratio", "revenue_growth", "credit_score"),
        "Finance", "Loan and portfolio risk", {"encoder": "angle", "circuit": "realamplitudes", "optimizer": "cobyla"},
    ),
    "supply_chain": Dataset(
        "supply_chain", "supply_chain_disruption.csv", "disruption_flag",
        ("supplier_delay_days", "inventory_turnover", "defect_rate", "shipping_cost_index", "demand_variance"),
        "Supply Chain", "Supplier disruption", {"encoder": "basis", "circuit": "efficientsu2", "optimizer": "spsa"},
    ),
    "hr": Dataset(
        "hr", "hr_attrition.csv", "attrition_flag",
        ("overtime_hours", "engagement_score", "years_at_company", "training_hours", "performance_score"),
        "Human Resources", "Employee attrition", {"encoder": "angle", "circuit": "realamplitudes", "optimizer": "cobyla"},
    ),
}

# Component names of the specs and what each is.
ENCODERS = {
    "angle": "angle encoding, second-order phases",
    "basis": "Z and ZZ phases (the same map as angle)",
    "iqp": "X, Z and ZZ phases (the same map up to a global phase at one repetition)",
    "rotation": "plain ry angles, the exact product circuit",
}
CIRCUITS = {
    "realamplitudes": "ry layer", "efficientsu2": "ry and rz layer", "twolocal": "ry and rz layer",
    "ry": "ry layer", "rz": "rz layer", "rx": "rx layer", "rxyz": "rx, ry and rz layer",
}
OPTIMIZERS = {
    "spsa": "simultaneous perturbation", "adam": "adaptive gradient",
    "cobyla": "gradient-free; runs as spsa", "slsqp": "gradient-based; runs as adam",
    "lbfgsb": "gradient-based; runs as adam", "l_bfgs_b": "gradient-based; runs as adam",
}


def component(registry: dict[str, str], name: str | None, default: str) -> str:
    """Registered name, case-insensitive; an unknown name raises."""
    key = (name or default).lower()
    if key not in registry:
        raise ValueError(f"unknown component {name!r}; known: {sorted(registry)}")
    return key


class Catalog:
    def __init__(self, folder: str | None = None):
        self._sets: dict[str, Dataset] = {}
        if folder is not None:
            for name, ds in DOMAINS.items():
                self._sets[name] = replace(ds, path=os.path.join(folder, ds.path))

    def register(self, dataset: Dataset) -> None:
        self._sets[dataset.name] = dataset

    def names(self) -> list[str]:
        return list(self._sets)

    def get(self, name: str) -> Dataset:
        if name not in self._sets:
            raise KeyError(f"no dataset {name!r}; known: {self.names()}")
        return self._sets[name]

    def listing(self, spark: SparkSession) -> DataFrame:
        """(name, path, label_column, feature_columns, domain, description, recommended), one row per dataset."""
        rows = [
            (d.name, d.path, d.label_column, list(d.feature_columns), d.domain, d.description, {k: str(v) for k, v in d.recommended.items()})
            for d in self._sets.values()
        ]
        return spark.createDataFrame(
            rows, "name string, path string, label_column string, feature_columns array<string>, domain string, description string, "
            "recommended map<string, string>"
        )

    def register_views(self, spark: SparkSession, prefix: str = "") -> dict[str, str]:
        """A temporary view of each dataset for ``spark.sql``: its name, by the dataset's. No file is read for a declared schema."""
        views = {name: f"`{prefix}{name}`" for name in self._sets}
        for name, dataset in self._sets.items():
            self.read(spark, dataset).createOrReplaceTempView(f"{prefix}{name}")
        return views

    @staticmethod
    def read(spark: SparkSession, dataset: Dataset) -> DataFrame:
        """The dataset's table by its declared schema, or by that of its files."""
        if dataset.path.rstrip("/").endswith(".parquet"):
            reader = spark.read.schema(dataset.schema) if dataset.schema else spark.read
            return reader.parquet(dataset.path)
        return read_csv(spark, dataset.path, dataset.schema) if dataset.schema else read_csv(spark, dataset.path)

    def resolve(self, spec: dict) -> Dataset:
        """Dataset of a spec: by name with explicit fields on top, or by path alone."""
        name = spec.get("name") or ""
        base = self._sets.get(name) or Dataset(name or "custom", "", "", ())
        if name in self._sets:
            found = replace(
                base,
                label_column=spec.get("label_column", base.label_column),
                feature_columns=tuple(spec.get("feature_columns", base.feature_columns) or ()),
            )
        else:
            if not spec.get("path"):
                raise ValueError("a dataset that is not in the catalog needs a path")
            found = replace(
                base, path=spec["path"], label_column=spec.get("label_column") or "",
                feature_columns=tuple(spec.get("feature_columns") or ()),
            )
        check_run(found.label_column, list(found.feature_columns))
        return found

    def load(self, spark: SparkSession, dataset: Dataset) -> DataFrame:
        """Parquet folder or header CSV, by suffix; the named columns must be there."""
        if dataset.path.rstrip("/").endswith(".parquet"):
            df = self.read(spark, dataset)
            if df.isEmpty():
                raise EmptyTable(f"no rows in {dataset.path}")
        else:
            df = read_nonempty(spark, dataset.path)
        return require_columns(df, [dataset.label_column, *dataset.feature_columns])
