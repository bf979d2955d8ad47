"""Scoring, triage, ranked review and argmax readouts; the flagship query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phasegrid.functions.readout import argmax, argmax_class
from phasegrid.operators.metrics import binary_metrics
from phasegrid.plans.model import VariationalModel
from phasegrid.queries.registry import LINE_KEY, SQL_KEYS, SQL_SCORED, THETA, line_scaler, query, split_lines
from phasegrid.sources.tables import table


def scored_lines(spark, folder):
    """Every lineitem scored with fixed parameters and the train-side scaler."""
    lines = split_lines(spark, folder)
    return VariationalModel(line_scaler(lines), THETA).score(lines)


def exact_scores(spark, folder):
    """(label, is_test, p) with the probability at full precision."""
    lines = split_lines(spark, folder)
    model = VariationalModel(line_scaler(lines), THETA)
    return lines.select(*LINE_KEY, "label", "is_test", model.probability().alias("p")).withColumn(
        "prediction", (F.col("p") > 0.5).cast("int")
    )


_SQL_RESULT = SQL_SCORED + """,
result AS (
  SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction,
         CASE WHEN p > 0.5 THEN 'HIGH RISK' ELSE 'low risk' END AS risk_label, round(p, 4) + 0.0 AS probability_class1,
         CASE WHEN p > 0.75 THEN 'act_first' WHEN p >= 0.5 THEN 'manual_review' ELSE 'low' END AS confidence
  FROM scored)"""


@query("score_rows", _SQL_RESULT + f" SELECT {SQL_KEYS}, prediction, risk_label, probability_class1, confidence FROM result")
def score_rows(spark, folder):
    return scored_lines(spark, folder).select(*LINE_KEY, "prediction", "risk_label", "probability_class1", "confidence")


@query("risk_labels", _SQL_RESULT + " SELECT risk_label, prediction, count(*) AS n FROM result GROUP BY risk_label, prediction")
def risk_labels(spark, folder):
    return scored_lines(spark, folder).groupBy("risk_label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("triage_bands", _SQL_RESULT + """
SELECT confidence, count(*) AS n, avg(label) AS positive_rate FROM result GROUP BY confidence""")
def triage_bands(spark, folder):
    return scored_lines(spark, folder).groupBy("confidence").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("positive_rate")
    )


def _review_order():
    return [F.desc("probability_class1"), *LINE_KEY]


@query("ranked_review", _SQL_RESULT + f" SELECT {SQL_KEYS}, probability_class1 FROM result ORDER BY probability_class1 DESC, {SQL_KEYS} LIMIT 50")
def ranked_review(spark, folder):
    scored = scored_lines(spark, folder)
    return scored.select(*LINE_KEY, "probability_class1").orderBy(*_review_order()).limit(50)


@query("ranked_review_by_supplier", _SQL_RESULT + f"""
SELECT {SQL_KEYS}, probability_class1, review_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY probability_class1 DESC, {SQL_KEYS}) AS INTEGER) AS review_rank FROM result)
WHERE review_rank <= 3""")
def ranked_review_by_supplier(spark, folder):
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*_review_order()))
    scored = scored_lines(spark, folder).select(*LINE_KEY, "probability_class1")
    return scored.withColumn("review_rank", place).where(F.col("review_rank") <= 3)


@query("argmax_readout", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS position,
       CAST((list_position(embedding, list_max(embedding)) - 1) % (SELECT count(DISTINCT label) FROM embeddings) AS INTEGER) AS prediction
FROM embeddings""")
def argmax_readout(spark, folder):
    vectors = table(spark, folder, "embeddings")
    classes = vectors.agg(F.count_distinct("label")).first()[0]
    return vectors.select(
        "vec_id", argmax(F.col("embedding")).alias("position"),
        argmax_class(F.col("embedding"), classes).cast("int").alias("prediction"),
    )


# ratios of counts are the same double in both engines, so they are compared unrounded
def sql_metrics(source: str, label: str = "label", prediction: str = "prediction", by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    tp, fp, fn = (f"count(*) FILTER (WHERE {label} = {y} AND {prediction} = {p})" for y, p in ((1, 1), (0, 1), (1, 0)))
    return f"""
SELECT {head}count(*) AS n_samples, count(*) FILTER (WHERE {label} = {prediction}) AS n_correct,
       count(*) FILTER (WHERE {label} = 0 AND {prediction} = 0) AS tn, {fp} AS fp, {fn} AS fn, {tp} AS tp,
       coalesce(count(*) FILTER (WHERE {label} = {prediction}) / nullif(count(*), 0), 0.0) AS accuracy,
       coalesce({tp} / nullif({tp} + {fp}, 0), 0.0) AS precision,
       coalesce({tp} / nullif({tp} + {fn}, 0), 0.0) AS recall,
       coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0) AS f1
FROM {source}{tail}"""


@query("risk_summary", _SQL_RESULT + sql_metrics("result", by="is_test"))
def risk_summary(spark, folder):
    """Flagship: features, label, hash split, train-side scaling, variational score, metrics per side."""
    return binary_metrics(exact_scores(spark, folder), "label", "prediction", by=["is_test"])
