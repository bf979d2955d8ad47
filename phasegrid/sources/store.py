"""JSON tables, run records and fitted models on shared storage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from phasegrid.plans.model import MODEL_SCHEMA, LinearModel, VariationalModel


def read_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.json(path, mode=mode)


def append_runs(runs: DataFrame, path: str) -> None:
    """Add run records to a table that holds one record for each ``run_id``.

    The id names the folder of a record, and a write replaces only the folders of the ids it holds. So a write that is
    repeated, after a lost driver or by a retried batch, leaves one record, and writers of other runs do not meet. An id
    that comes several times in one write keeps all its rows; a null id raises.
    """
    named = runs.withColumn("run_id", F.coalesce(F.col("run_id").cast("string"), F.raise_error(F.lit("a run record has no run_id")).cast("string")))
    named.write.option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path, mode="overwrite")


def read_runs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The records; ids are text whatever they look like. ``schema`` (as RUN_SCHEMA) saves the look into the files."""
    if schema is None:
        fields = [f for f in spark.read.parquet(path).schema.fields if f.name != "run_id"]
        full = StructType([*fields, StructField("run_id", StringType())])
        return spark.read.schema(full).parquet(path)
    return spark.read.schema(schema).parquet(path)


def save_model(
    spark: SparkSession, model: VariationalModel, path: str, baseline: LinearModel | None = None, spec: dict | None = None,
    replace: bool = False,
) -> None:
    """One parquet row: parameters, scaler statistics, resolved columns and settings; the baseline and the spec beside them.

    An existing model raises, or is replaced, so that a repeated run can write its own again.
    """
    beside = None if baseline is None else (list(baseline.weights), baseline.intercept)
    row = (*model.to_row(), beside, None if spec is None else json.dumps(spec, default=str))
    spark.createDataFrame([row], MODEL_SCHEMA).coalesce(1).write.parquet(path, mode="overwrite" if replace else "errorifexists")


def load_model(spark: SparkSession, path: str) -> VariationalModel:
    return load_artefact(spark, path)[0]


def load_artefact(spark: SparkSession, path: str) -> tuple[VariationalModel, LinearModel | None, dict | None]:
    """The model, its baseline and the spec it was trained from; the last two are None where they were not saved."""
    row = spark.read.schema(MODEL_SCHEMA).parquet(path).first()
    model, beside = VariationalModel.from_row(row), row["baseline"]
    baseline = None if beside is None else LinearModel(model.features, tuple(beside["weights"]), beside["intercept"])
    return model, baseline, None if row["spec"] is None else json.loads(row["spec"])
