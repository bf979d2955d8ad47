"""Literal cases and invariants of profiling, preparation, measurement and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from phasegrid.functions import readout, values
from phasegrid.operators import columns as C
from phasegrid.operators import labels as L
from phasegrid.operators import measurement as Q
from phasegrid.operators import metrics as M
from phasegrid.operators import profile as P
from phasegrid.operators import runs as R
from phasegrid.operators import scaling as S
from phasegrid.operators import specs


def pairs(spark, truth, predicted):
    return spark.createDataFrame(list(zip(truth, predicted)), "label int, prediction int")


@pytest.mark.parametrize("truth,predicted,want", [
    ([0, 1, 2, 1], [0, 1, 2, 1], 1.0), ([0, 1, 2], [1, 2, 0], 0.0), ([0, 1, 1, 0], [0, 1, 0, 1], 0.5), ([], [], 0.0),
])
def test_accuracy(spark, truth, predicted, want):
    row = M.accuracy(pairs(spark, truth, predicted), "label", "prediction").first()
    assert (row["accuracy"], row["n_samples"]) == (want, len(truth)) and isinstance(row["accuracy"], float)


def matrix(df):
    return {(r["label"], r["prediction"]): r["n"] for r in df.collect()}


def test_confusion_shape_and_rows(spark):
    df = pairs(spark, [0, 0, 1, 1, 2], [0, 1, 1, 0, 2])
    cells = matrix(M.confusion_matrix(df, "label", "prediction"))
    assert len(cells) == 9
    assert [sum(cells[t, p] for p in range(3)) for t in range(3)] == [2, 2, 1]
    assert len(matrix(M.confusion_matrix(df, "label", "prediction", 4))) == 16


def test_confusion_all_wrong_and_absent_class(spark):
    assert matrix(M.confusion_binary(pairs(spark, [0, 1], [1, 0]), "label", "prediction")) == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 0}
    assert matrix(M.confusion_binary(pairs(spark, [0], [0]), "label", "prediction"))[1, 1] == 0


def test_zero_division(spark):
    row = M.binary_metrics(pairs(spark, [0, 0, 1], [0, 0, 0]), "label", "prediction").first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (0, 1, 1.0)], "label int, prediction int, p double")
    row = M.binary_metrics(df, "label", "prediction", "p").first()
    assert row["log_loss"] == pytest.approx(-math.log(1e-15), rel=0.01)


def test_majority_baseline_ties(spark):
    df = pairs(spark, [1, 0, 0, 1], [0] * 4)
    assert tuple(M.majority_baseline(df, "label").first()) == (0, 0.5)


def test_counts_to_probabilities(spark):
    rows = [(1, s, 256) for s in ("00", "01", "10", "11")] + [(2, "01", 3), (2, "01", 1)]
    got = {r[0]: r[1] for r in Q.distribution(spark.createDataFrame(rows, "s int, b string, n int"), "s", "b", "n", 2).collect()}
    assert got == {1: [0.25] * 4, 2: [0.0, 0.0, 1.0, 0.0]}  # "01" reversed is index 2
    one = spark.createDataFrame([(1, "0", 1024)], "s int, b string, n int")
    assert Q.distribution(one, "s", "b", "n", 3).first()["probabilities"] == [1.0] + [0.0] * 7


def test_strings_beyond_the_vector_count_in_the_total(spark):
    rows = spark.createDataFrame([(1, "001", 3), (1, "000", 1)], "s int, b string, n int")
    assert Q.distribution(rows, "s", "b", "n", 2).first()["probabilities"] == [0.25, 0.0, 0.0, 0.0]


def test_expectation_and_parity(spark):
    rows = spark.createDataFrame([(1, "01", 3), (1, "10", 1)], "s int, b string, n int")
    z = {r["qubit"]: r["expectation"] for r in Q.z_expectation(rows, "s", "b", "n", 2).collect()}
    assert z == {0: -0.5, 1: 0.5}
    assert tuple(Q.parity_readout(rows, "s", "b", "n").first())[1:] == (0.0, 1.0)


def test_preprocess(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 4.0), (5.0, 6.0)], "a double, b double")
    out = S.preprocess(df, ["a", "b"]).collect()
    flat = [v for r in out for v in r]
    assert min(flat) == 0.0 and max(flat) == 1.0 and None not in flat
    single = S.preprocess(spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double"), ["a", "b", "c"])
    assert [tuple(r) for r in single.collect()] == [(0.0, 0.0, 0.0)]


def test_standard_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = S.fit_standard(df, ["a", "b"])
    assert [tuple(r) for r in scaler.apply(df).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(C.MissingColumns):
        scaler.apply(df.drop("b"))
    with pytest.raises(ValueError):
        S.fit_standard(df.where("a > 9"), ["a"])


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (2.0, "y")], "a double, s string")
    row = P.numeric_profile(values.nan_to_null(df), ["a"]).first()
    assert (row["mean"], row["std"], row["null_count"], row["n_rows"]) == (2.0, None, 1, 2)


def test_profile_rounds_half_even(spark):
    df = spark.createDataFrame([(0.00005,)], "a double")
    assert P.numeric_profile(df, ["a"]).first()["mean"] == 0.0


def test_categorical_profile(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbccdefg"] + [(None,)], "s string")
    top = [(r["value"], r["n"]) for r in P.categorical_profile(df, ["s"]).orderBy("value_rank").collect()]
    assert top == [("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", 1)]
    assert tuple(P.categorical_summary(df, ["s"]).first()) == ("s", 7, 1)


def test_top_values_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("s"))
    plan = P.categorical_profile(df, ["s"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("n,band", [(59, "too_few"), (60, "marginal"), (80, "good"), (150, "very_good"), (500, "very_good"), (501, "slow_sample_advised")])
def test_row_bands(spark, n, band):
    df = spark.range(n).select(*[F.col("id").cast("double").alias(c) for c in "abc"], (F.col("id") % 2).alias("y"))
    status = {r["rule"]: r["status"] for r in P.suitability(df, list("abc"), "y").collect()}
    assert status == {"row_count": band, "feature_count": "fast", "no_missing_values": "ok", "label_is_0_or_1": "ok", "class_balance": "ok"}


def test_suitability_violations(spark):
    df = spark.createDataFrame([(None, 2.0), (1.0, 1.0), (1.0, None), (1.0, 1.0)], "a double, y double")
    found = {r["rule"]: (r["observed"], r["status"]) for r in P.suitability(df, ["a"], "y").collect()}
    assert found["no_missing_values"] == (2.0, "violated") and found["label_is_0_or_1"] == (2.0, "violated")
    assert found["class_balance"] == (1.0, "violated") and found["feature_count"][1] == "few"


def test_leak_check_of_large_values(spark):
    df = spark.range(1000).select((F.col("id") + 1_700_000_000_000).cast("double").alias("at"), (F.col("id") * 2).alias("y"))
    assert P.leak_check(df, ["at"], "y").first()["abs_r"] > 0.999999


def test_leak_check(spark):
    df = spark.range(100).select(
        (F.col("id") % 2).alias("y"), (F.col("id") % 2 * 3.0).alias("copy"), (F.col("id") % 5).alias("noise"), F.col("id").alias("key"),
        F.pow(F.lit(-1.0), F.col("id") % 4).alias("pure"),
    )
    leaks = {r["feature"]: r["is_leak"] for r in P.leak_check(df, ["copy", "noise", "key", "pure"], "y").collect()}
    assert leaks == {"copy": True, "noise": False, "key": False, "pure": True}


@pytest.mark.parametrize("block", [1000, 3])
def test_correlations_with_gaps_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_COLUMNS", block)
    df = spark.range(50).select(
        "id", (F.col("id") * 2).alias("twice"), (-F.col("id")).alias("minus"), (F.col("id") % 2).alias("odd"), F.lit(7.0).alias("same"),
        F.when(F.col("id") % 3 > 0, F.col("id") + 1e12).alias("gaps"), F.when(F.col("id") < 40, F.sin("id")).otherwise(F.lit(float("nan"))).alias("nans"),
    ).repartition(4)
    names = ["id", "twice", "minus", "odd", "same", "gaps", "nans"]
    got = {(r[0], r[1]): r[2] for r in P.correlated_pairs(df, names, 0.0).collect()}
    clean = df.withColumn("nans", F.nanvl("nans", F.lit(None)))
    for a, b in [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]:
        want = clean.select(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))).first()[0] if "same" not in (a, b) else None
        assert (got.get((a, b)) is None) == (want is None) and (want is None or got[a, b] == pytest.approx(want, abs=1e-6))
    assert {p for p, r in got.items() if abs(r) >= 0.9} >= {("id", "twice"), ("id", "minus"), ("id", "gaps")}


def test_two_hundred_columns_in_one_scan(spark, tmp_path):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    cells = rng.normal(size=(2000, 200)) @ rng.normal(size=(200, 200)) * 10 + rng.normal(size=200) * 1e6
    names = [f"f{k}" for k in range(200)]
    spark.createDataFrame(pd.DataFrame(cells, columns=names)).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    pairs = P.correlated_pairs(df, names, 0.0)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = np.corrcoef(cells.T)
    got = pairs.collect()
    assert len(got) == 19_900
    assert max(abs(r["r"] - want[int(r["feature_a"][1:]), int(r["feature_b"][1:])]) for r in got) < 1e-9


def test_key_like_columns_come_from_sketches(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") < 15_000, 7).otherwise(F.col("id")).cast("string").alias("key"), (F.col("id") % 9).alias("flag"),
        F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 4 > 0, F.col("id") % 800).alias("gaps"),
    )
    found = {}
    for r in P.value_profile(df, df.columns).collect():
        found.setdefault(r["column_name"], []).append(r)
    key = sorted(found["key"], key=lambda r: r["value_rank"])
    assert key[0]["is_approximate"] and abs(key[0]["n_distinct"] / 45_001 - 1) < 4 * key[0]["distinct_error"]
    assert key[0]["value"] == "7" and abs(key[0]["n"] - 15_000) <= key[0]["count_error"]
    assert not any(r["is_approximate"] for c in ("flag", "none", "gaps") for r in found[c])
    assert [r["n"] for r in sorted(found["flag"], key=lambda r: r["value_rank"])] == [6667] * 5 and found["flag"][0]["n_distinct"] == 9
    assert (found["none"][0]["n_distinct"], found["none"][0]["null_count"], found["none"][0]["value"]) == (0, 60_000, None)
    assert found["gaps"][0]["null_count"] == 15_000 and found["gaps"][0]["n_distinct"] == 600
    empty = P.value_profile(df.where("false"), ["flag"]).collect()
    assert [(r["n_distinct"], r["null_count"], r["value"]) for r in empty] == [(0, 0, None)]
