"""Round trips through files: CSV, JSON and stored models, under the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from phasegrid.operators.columns import missing_columns
from phasegrid.operators.runs import run_label
from phasegrid.plans.model import VariationalModel
from phasegrid.plans.train import RUN_SCHEMA, train_run
from phasegrid.queries.registry import LINE_KEY, SQL_KEYS, SQL_SCORED, THETA, line_scaler, query, rounded, split_lines
from phasegrid.queries.scoring import scored_lines
from phasegrid.session import shared_folder
from phasegrid.sources import csv, store
from phasegrid.sources.catalog import Catalog, Dataset
from phasegrid.sources.tables import table

_CSV_SCHEMA = (
    "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, prediction int, risk_label string, "
    "probability_class1 double, confidence string"
)


@query("csv_round_trip", SQL_SCORED + """
SELECT CASE WHEN p > 0.5 THEN 'HIGH RISK' ELSE 'low risk' END AS risk_label, count(*) AS n,
       round(sum(round(p, 4)), 6) + 0.0 AS total_probability, CAST(sum(l_orderkey) AS BIGINT) AS key_sum
FROM scored GROUP BY 1""")
def csv_round_trip(spark, folder):
    """All scored rows to a quoted CSV folder, read back with a schema and summed."""
    path = shared_folder(spark, "scored-csv")
    names = [c.split()[0] for c in _CSV_SCHEMA.split(", ")]
    csv.write_csv(scored_lines(spark, folder).select(*names), path)
    back = csv.read_csv(spark, path, _CSV_SCHEMA)
    return rounded(back.groupBy("risk_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("probability_class1").alias("total_probability"), F.sum("l_orderkey").alias("key_sum")
    ), ["total_probability"])


@query("csv_inferred", """
SELECT 'event_id:bigint,value:double,event_type:string,flag:boolean' AS types, count(*) AS n_rows,
       count(*) FILTER (WHERE event_type = 'error') AS n_missing, CAST(sum(event_id) AS BIGINT) AS key_sum,
       round(sum(value) FILTER (WHERE event_type <> 'error'), 6) + 0.0 AS total FROM events""")
def csv_inferred(spark, folder):
    """CSV with missing tokens, read back with inferred types."""
    path = shared_folder(spark, "events-csv")
    value = F.when(F.col("event_type") == "error", "N/A").otherwise(F.col("value").cast("string")).alias("value")
    flag = (F.col("event_id") % 2 == 0).alias("flag")
    csv.write_csv(table(spark, folder, "events").select("event_id", value, "event_type", flag), path)
    back = csv.read_csv(spark, path)
    types = ",".join(f"{c}:{t}" for c, t in back.dtypes)
    return rounded(back.agg(
        F.lit(types).alias("types"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.sum("event_id").alias("key_sum"), F.sum("value").alias("total"),
    ), ["total"])


@query("csv_rejects", """
SELECT event_type, count(*) AS n_rows, CAST(sum((event_type IN ('error', 'click'))::INT) AS BIGINT) AS n_malformed,
       round(coalesce(sum(CASE WHEN event_type NOT IN ('error', 'click') THEN value END), 0.0), 6) + 0.0 AS total
FROM events GROUP BY event_type""")
def csv_rejects(spark, folder):
    """Lines with a bad number or a surplus cell are kept apart and counted."""
    cells = (
        F.when(F.col("event_type") == "error", F.concat_ws(",", "event_id", F.lit("oops")))
        .when(F.col("event_type") == "click", F.concat_ws(",", "event_id", "value", F.lit("surplus")))
        .otherwise(F.concat_ws(",", "event_id", "value"))
    )
    lines = table(spark, folder, "events").select("event_type", cells.alias("line"))
    rows = csv.parse_lines(lines, "line", "id bigint, value double")
    bad = F.col(csv.CORRUPT).isNotNull()
    return rounded(rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_malformed"),
        F.coalesce(F.sum(F.when(~bad, F.col("value"))), F.lit(0.0)).alias("total"),
    ), ["total"])


@query("json_round_trip", "SELECT doc_id, quality, toxic FROM labels")
def json_round_trip(spark, folder):
    path = shared_folder(spark, "labels-json")
    store.write_json(table(spark, folder, "labels"), path)
    return store.read_json(spark, path, "doc_id bigint, quality int, toxic int")


@query("model_round_trip", SQL_SCORED + f" SELECT {SQL_KEYS}, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction, round(p, 4) + 0.0 AS probability_class1 FROM scored")
def model_round_trip(spark, folder):
    """A model saved as one parquet row scores the table after reloading."""
    lines = split_lines(spark, folder)
    path = shared_folder(spark, "model")
    store.save_model(spark, VariationalModel(line_scaler(lines), THETA), path)
    scored = store.load_model(spark, path).score(lines)
    return scored.select(*LINE_KEY, "prediction", "probability_class1")


@query("run_log", """
SELECT o_orderstatus || '-' || CAST(o_custkey % 4 AS VARCHAR) AS run_id, 'orders | angle | cir | opt' AS run_label, 'ok' AS status,
       count(*) AS n_train, round(avg((o_totalprice > 150000)::INT), 6) + 0.0 AS accuracy, 'orders' AS dataset_name
FROM orders GROUP BY ALL""")
def run_log(spark, folder):
    """Full run records in three writes, one of them repeated: one record for each run."""
    path = shared_folder(spark, "runs")
    none = F.lit(None).cast("string")
    groups = table(spark, folder, "orders").groupBy(
        F.concat_ws("-", "o_orderstatus", (F.col("o_custkey") % 4).cast("string")).alias("run_id")
    ).agg(F.count(F.lit(1)).alias("n_train"), F.avg((F.col("o_totalprice") > 150_000).cast("int")).alias("accuracy"))
    given = {
        "run_id": F.col("run_id"), "run_label": run_label(F.lit("orders"), F.lit("angle"), none, none), "status": F.lit("ok"),
        "n_train": F.col("n_train"), "accuracy": F.col("accuracy"),
    }
    fields = StructType.fromDDL(RUN_SCHEMA).fields
    dataset = next(f.dataType for f in fields if f.name == "dataset")
    given["dataset"] = F.struct(*[(F.lit("orders") if f.name == "name" else F.lit(None)).cast(f.dataType).alias(f.name) for f in dataset.fields])
    records = groups.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    first, second = F.col("run_id") < "G", F.col("run_id") < "P"
    for part in (first, ~first & second, ~first & second, ~second):
        store.append_runs(records.where(part), path)
    kept = store.read_runs(spark, path, RUN_SCHEMA)
    return rounded(kept.select("run_id", "run_label", "status", "n_train", "accuracy", F.col("dataset.name").alias("dataset_name")), ["accuracy"])


@query("model_artefact", """
WITH d AS (SELECT DISTINCT quality FROM labels WHERE quality IS NOT NULL)
SELECT 'labels' AS dataset_name, 'toxic' AS feature_columns, 2 AS n_parameters, true AS same_model, true AS same_baseline, 2 AS layers, count(*) AS n_classes FROM d""")
def model_artefact(spark, folder):
    """A model trained with two layers, saved with its baseline and spec, then saved again and read back."""
    path = shared_folder(spark, "artefacts")
    catalog = Catalog()
    catalog.register(Dataset("labels", f"{folder}/labels.parquet", "quality", ("toxic",)))
    spec = {"dataset": {"name": "labels", "key_columns": ["doc_id"]}, "encoder": {"type": "rotation"},
            "circuit": {"type": "ry", "reps": 2}, "optimizer": {"type": "adam", "maxiter": 2}}
    for _ in range(2):
        run = train_run(spark, spec, catalog, "run-7", path)
    model, baseline, kept = store.load_artefact(spark, f"{path}/run-7")
    classes = table(spark, folder, "labels").where("quality IS NOT NULL").select("quality").distinct()
    return classes.agg(
        F.lit(kept["dataset"]["name"]).alias("dataset_name"), F.lit(",".join(model.features)).alias("feature_columns"),
        F.lit(len(model.theta)).alias("n_parameters"), F.lit(model == run.model).alias("same_model"),
        F.lit(baseline == run.baseline).alias("same_baseline"), F.lit(kept["circuit"]["reps"]).alias("layers"), F.count("*").alias("n_classes"),
    )


_SETS = {
    "lines": ("lineitem", "l_linestatus", ("l_quantity", "l_tax"), {"encoder": "rotation", "maxiter": "20"},
              "l_linestatus string, l_quantity double, l_tax double"),
    "toxic": ("labels", "toxic", ("quality",), {"encoder": "angle"}, ""),
    "custom": ("orders", "o_orderstatus", ("o_totalprice",), {}, ""),
}


@query("catalog_listing", " UNION ALL ".join(f"""
SELECT '{n}' AS name, '{label}' AS label_column, '{','.join(features)}' AS feature_columns, '{said.get('encoder', '')}' AS encoder,
       count(*) AS n_rows, count(DISTINCT {label}) AS n_classes FROM {t}""" for n, (t, label, features, said, _) in _SETS.items()))
def catalog_listing(spark, folder):
    """Registered sets and one that is named by its path alone, as views that SQL reads."""
    catalog = Catalog()
    for name, (t, label, features, said, schema) in _SETS.items():
        path = f"{folder}/{t}.parquet"
        if name == "custom":
            catalog.register(catalog.resolve({"path": path, "label_column": label, "feature_columns": list(features)}))
        else:
            catalog.register(Dataset(name, path, label, features, recommended=said, schema=schema))
    views = catalog.register_views(spark, "cat_")
    counts = [f"SELECT '{n}' AS name, count(*) AS n_rows, count(DISTINCT {_SETS[n][1]}) AS n_classes FROM {v}" for n, v in views.items()]
    listed = catalog.listing(spark).select(
        "name", "label_column", F.array_join("feature_columns", ",").alias("feature_columns"), F.coalesce(F.col("recommended")["encoder"], F.lit("")).alias("encoder")
    )
    return listed.join(spark.sql(" UNION ALL ".join(counts)), "name")


_WANTED = {"lineitem": ("l_quantity", "l_rate", "l_tax"), "orders": ("o_orderkey",), "labels": ("quality", "Toxic", "doc_id", "extra")}


@query("required_columns", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{m}' AS missing, count(*) AS n_rows FROM {t}" for t, m in (("lineitem", "l_rate"), ("orders", ""), ("labels", "Toxic,extra"))))
def required_columns(spark, folder):
    """Columns that a table lacks, and its rows."""
    out = None
    for t, names in _WANTED.items():
        df = table(spark, folder, t)
        row = df.agg(F.lit(t).alias("table_name"), F.lit(",".join(missing_columns(df, names))).alias("missing"), F.count("*").alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out
