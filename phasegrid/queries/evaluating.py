"""Metrics and run analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phasegrid.functions.readout import argmax_class, number_text, percent_text
from phasegrid.operators import metrics as M
from phasegrid.operators import runs as R
from phasegrid.queries.registry import SQL_SCORED, query, rounded
from phasegrid.queries.scoring import exact_scores, sql_metrics
from phasegrid.sources.tables import table

_SQL_PREDICTED = SQL_SCORED + ", result AS (SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction FROM scored)"


@query("accuracy", "SELECT avg((quality = toxic)::INT) AS accuracy, count(*) AS n_samples, count(*) FILTER (WHERE quality = toxic) AS n_correct FROM labels")
def accuracy(spark, folder):
    return M.accuracy(table(spark, folder, "labels"), "quality", "toxic")


@query("confusion_binary", """
SELECT CAST(l AS INTEGER) AS label, CAST(p AS INTEGER) AS prediction, count(quality) AS n
FROM (SELECT unnest([0, 1]) AS l) a CROSS JOIN (SELECT unnest([0, 1]) AS p) b LEFT JOIN labels ON quality = l AND toxic = p GROUP BY l, p""")
def confusion_binary(spark, folder):
    return M.confusion_binary(table(spark, folder, "labels"), "quality", "toxic")


def _argmax_predictions(spark, folder):
    vectors = table(spark, folder, "embeddings")
    classes = vectors.agg(F.count_distinct("label")).first()[0]
    return vectors.select("label", argmax_class(F.col("embedding"), classes).cast("int").alias("prediction"))


_SQL_ARGMAX = """
WITH c AS (SELECT count(DISTINCT label) AS n FROM embeddings),
pr AS (SELECT label, CAST((list_position(embedding, list_max(embedding)) - 1) % n AS INTEGER) AS prediction FROM embeddings, c)"""


@query("confusion_multi", _SQL_ARGMAX + """,
k AS (SELECT unnest(range((SELECT max(greatest(label, prediction)) + 1 FROM pr))) AS i)
SELECT CAST(a.i AS INTEGER) AS label, CAST(b.i AS INTEGER) AS prediction, count(pr.label) AS n
FROM k a CROSS JOIN k b LEFT JOIN pr ON pr.label = a.i AND pr.prediction = b.i GROUP BY a.i, b.i""")
def confusion_multi(spark, folder):
    return M.confusion_matrix(_argmax_predictions(spark, folder), "label", "prediction")


@query("evaluate_argmax", _SQL_ARGMAX + """
SELECT avg((label = prediction)::INT) AS accuracy, count(*) AS n_samples, count(*) FILTER (WHERE label = prediction) AS n_correct FROM pr""")
def evaluate_argmax(spark, folder):
    return M.accuracy(_argmax_predictions(spark, folder), "label", "prediction")


@query("prf", "SELECT * FROM (" + sql_metrics("(SELECT quality AS label, toxic AS prediction FROM labels)") + ")")
def prf(spark, folder):
    return M.binary_metrics(table(spark, folder, "labels"), "quality", "toxic")


@query("prf_by_supplier", _SQL_PREDICTED + sql_metrics("result", by="l_suppkey"))
def prf_by_supplier(spark, folder):
    return M.binary_metrics(exact_scores(spark, folder), "label", "prediction", by=["l_suppkey"])


def _sql_auc(source: str, label: str, score: str) -> str:
    return f"""
by_score AS (SELECT {score} AS s, count(*) FILTER (WHERE {label} = 1) AS pos, count(*) FILTER (WHERE {label} = 0) AS neg FROM {source} GROUP BY 1),
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_score)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) + 0.0 AS roc_auc FROM cum"""


@query("auc", _SQL_PREDICTED + "," + _sql_auc("(SELECT * FROM result WHERE is_test)", "label", "p"))
def auc(spark, folder):
    return rounded(M.roc_auc(exact_scores(spark, folder).where("is_test"), "label", "p"), ["roc_auc"])


@query("auc_ties", _SQL_PREDICTED + "," + _sql_auc("result", "label", "round(p, 4)"))
def auc_ties(spark, folder):
    scores = exact_scores(spark, folder).withColumn("p", F.round("p", 4))
    return rounded(M.roc_auc(scores, "label", "p"), ["roc_auc"])


@query("log_loss", _SQL_PREDICTED + """
SELECT is_test, round(avg(-CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END), 6) + 0.0 AS log_loss
FROM (SELECT *, greatest(least(p, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE) AS q FROM result) GROUP BY is_test""")
def log_loss(spark, folder):
    scores = exact_scores(spark, folder)
    return rounded(M.binary_metrics(scores, "label", "prediction", "p", ["is_test"]).select("is_test", "log_loss"), ["log_loss"])


@query("majority_baseline", """
SELECT toxic AS majority_class, n / (SELECT count(*) FROM labels WHERE toxic IS NOT NULL) AS baseline_accuracy
FROM (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic) ORDER BY n DESC, toxic LIMIT 1""")
def majority_baseline(spark, folder):
    return M.majority_baseline(table(spark, folder, "labels"), "toxic")


# loss histories from lineitem: a run per order, a point per line number
_SQL_HISTORY = """
WITH points AS (SELECT l_orderkey, l_linenumber, avg(l_discount) + 0.01 * l_linenumber AS loss FROM lineitem GROUP BY l_orderkey, l_linenumber),
steps AS (SELECT l_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS step, loss FROM points)"""


def _history(spark, folder):
    points = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        (F.avg("l_discount") + 0.01 * F.col("l_linenumber")).alias("loss")
    )
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    return points.select(F.col("l_orderkey").alias("run_id"), step.alias("step"), "loss")


@query("loss_curve_padded", _SQL_HISTORY + """,
ends AS (SELECT run_id, max(step) AS last, arg_max(loss, step) AS final FROM steps GROUP BY run_id)
SELECT run_id, step, round(loss, 6) + 0.0 AS loss, false AS is_padded FROM steps
UNION ALL
SELECT run_id, CAST(g AS INTEGER), round(final, 6) + 0.0, true FROM ends, range(5) r(g) WHERE g > last""")
def loss_curve_padded(spark, folder):
    return rounded(R.pad_loss_curve(_history(spark, folder), "run_id", "step", "loss", 5), ["loss"])


# a run per supplier: the scored lines of that supplier against its majority class
_SQL_RUNS = _SQL_PREDICTED + """,
runs AS (
  SELECT l_suppkey AS run_id, avg((label = prediction)::INT) AS accuracy,
         2 * count(*) FILTER (WHERE label = 1 AND prediction = 1)
           / nullif(2 * count(*) FILTER (WHERE label = 1 AND prediction = 1) + count(*) FILTER (WHERE label <> prediction), 0) AS f1,
         CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE avg(label) END AS roc_auc,
         greatest(avg(label), 1 - avg(label)) - 0.01 * (l_suppkey % 12) AS baseline_accuracy
  FROM result GROUP BY l_suppkey)"""


def runs_table(spark, folder):
    m = M.binary_metrics(exact_scores(spark, folder), "label", "prediction", by=["l_suppkey"])
    rate = (F.col("tp") + F.col("fn")) / F.col("n_samples")
    supplier = F.col("l_suppkey")
    f1 = F.try_divide((2 * F.col("tp")).cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return m.select(
        supplier.alias("run_id"), "accuracy", f1.alias("f1"),
        F.when(supplier % 5 != 0, rate).alias("roc_auc"),
        (F.greatest(rate, 1 - rate) - 0.01 * (supplier % 12)).alias("baseline_accuracy"),
    )


@query("run_compare", _SQL_RUNS + """,
filled AS (SELECT run_id, coalesce(accuracy, 0.0) AS accuracy, coalesce(f1, 0.0) AS f1, coalesce(roc_auc, 0.0) AS roc_auc,
                  coalesce(baseline_accuracy, 0.0) AS baseline_accuracy FROM runs)
SELECT run_id, accuracy, f1, roc_auc,
       round(baseline_accuracy, 9) + 0.0 AS baseline_accuracy, round(accuracy - baseline_accuracy, 9) + 0.0 AS gain,
       rank() OVER (ORDER BY accuracy DESC) AS accuracy_rank FROM filled""")
def run_compare(spark, folder):
    return rounded(R.compare_runs(runs_table(spark, folder)), ["baseline_accuracy", "gain"], 9)


@query("readiness_gate", _SQL_RUNS + """,
g AS (SELECT *, accuracy + 0.12 AS a, coalesce(f1, 0.0) + 0.15 AS f, round(accuracy + 0.12 - baseline_accuracy, 9) AS gain FROM runs)
SELECT run_id,
  CASE WHEN a < 0.65 OR f < 0.6 OR gain < -0.02 THEN 'not_ready' WHEN gain >= 0.08 AND f > 0.72 THEN 'strong'
       WHEN gain >= 0.03 AND f > 0.65 THEN 'screening' ELSE 'borderline' END AS readiness,
  CASE WHEN gain < 0 THEN 'below' WHEN gain <= 0.05 THEN 'marginal' WHEN gain <= 0.15 THEN 'good' ELSE 'strong' END AS improvement,
  a >= 0.7 AND f > 0.68 AS deployable FROM g""")
def readiness_gate(spark, folder):
    # shifted up, so that the runs spread over all gates
    runs = runs_table(spark, folder).select(
        "run_id", (F.col("accuracy") + 0.12).alias("a"), (F.coalesce("f1", F.lit(0.0)) + 0.15).alias("f"), "baseline_accuracy"
    )
    a, f, b = F.col("a"), F.col("f"), F.col("baseline_accuracy")
    return runs.select(
        "run_id", R.readiness(a, f, b).alias("readiness"), R.improvement_band(a, b).alias("improvement"),
        R.deployable(a, f).alias("deployable"),
    )


@query("run_label", """
SELECT o_orderstatus || ' | ' || CASE WHEN o_orderstatus = 'F' THEN 'enc' ELSE lower(o_orderpriority) END || ' | cir | ' || o_orderstatus AS run_label,
       count(*) AS n FROM orders GROUP BY 1""")
def run_label(spark, folder):
    encoder = F.when(F.col("o_orderstatus") != "F", F.lower("o_orderpriority"))
    status = F.col("o_orderstatus")
    label = R.run_label(status, encoder, F.lit(None).cast("string"), status)
    return table(spark, folder, "orders").groupBy(label.alias("run_label")).agg(F.count(F.lit(1)).alias("n"))


@query("display_text", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '--' ELSE format('{:.1f}%', v * 100) END AS percent_text,
       CASE WHEN o_orderstatus = 'P' THEN '--' ELSE format('{:.3f}', v) END AS number_text
FROM (SELECT *, (o_orderkey % 991) / 997.0::DOUBLE AS v FROM orders)""")
def display_text(spark, folder):
    value = F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 991) / 997.0)
    return table(spark, folder, "orders").select(
        "o_orderkey", percent_text(value).alias("percent_text"), number_text(value).alias("number_text")
    )
