"""Missing and not-a-number values, and inputs beyond the usual sizes."""

import math

from pyspark.sql import functions as F

from phasegrid.functions.readout import class_from_probability, confidence_band, risk_label
from phasegrid.operators.measurement import parity_readout
from phasegrid.operators.metrics import log_loss_term
from phasegrid.operators.profile import correlated_pairs
from phasegrid.plans.model import _loss_sql, _parity_sql


def test_log_loss_skips_unknown_rows(spark):
    rows = [(1, 0.9), (1, None), (None, 0.9), (0, float("nan"))]
    frame = spark.createDataFrame(rows, "label int, p double")
    assert abs(frame.agg(F.avg(log_loss_term(F.col("label"), F.col("p")))).first()[0] + math.log(0.9)) < 1e-12


def test_training_loss_skips_rows_with_a_missing_feature(spark):
    frame = spark.createDataFrame([(1, 0.2), (1, None), (0, float("nan"))], "label int, x double")
    frame = frame.selectExpr("label", f"{_parity_sql(['x'])} AS p")
    assert abs(frame.selectExpr(f"{_loss_sql('p')} AS loss").first()[0] + math.log(0.4)) < 1e-12


def test_unknown_probability_has_no_class(spark):
    frame = spark.createDataFrame([(float("nan"),), (None,), (0.8,), (0.2,)], "p double")
    p = F.col("p")
    prediction = class_from_probability(p)
    got = [tuple(r) for r in frame.select(prediction, risk_label(prediction), confidence_band(p)).collect()]
    assert got == [(None, None, None), (None, None, None), (1, "HIGH RISK", "act_first"), (0, "low risk", "low")]


def test_parity_of_long_strings(spark):
    frame = spark.createDataFrame([(1, "1" + "0" * 69, 3), (1, "11" + "0" * 68, 1)], "s int, bits string, n int")
    assert parity_readout(frame, "s", "bits", "n").first()["p_odd"] == 0.75


def test_one_feature_has_no_pairs(spark):
    got = correlated_pairs(spark.createDataFrame([(1.0,)], "a double"), ["a"], 0.5)
    assert got.columns == ["feature_a", "feature_b", "r"] and got.count() == 0
