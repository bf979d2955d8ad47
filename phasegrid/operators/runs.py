"""Run records: loss curves, comparison, readiness gates and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.operators.selection import running_totals
from phasegrid.session import stored

# Limits of the readiness guide.
BASELINE_MARGIN, SCREENING_GAIN, STRONG_GAIN = 0.02, 0.03, 0.08
SCREENING_F1, STRONG_F1 = 0.65, 0.72
ACCURACY_FLOOR, F1_FLOOR = 0.65, 0.60
DEPLOY_ACCURACY, DEPLOY_F1 = 0.70, 0.68
#: Keys over which the runs of one accuracy are dealt.
SALTS = 16


def pad_loss_curve(history: DataFrame, run: str, step: str, loss: str, requested: int) -> DataFrame:
    """(run, step, loss, is_padded): each curve reaches max(observed, requested, 2) points.

    Steps count from 0. The observed points pass through; one aggregate per run finds the last loss
    and generates only the missing points, so no curve is gathered or sorted.
    """
    ends = history.groupBy(run).agg(F.max(step).alias("last"), F.max_by(loss, step).alias("final"))
    length = max(requested, 2)
    missing = ends.where(F.col("last") < length - 1).select(
        run,
        F.explode(F.sequence(F.col("last").cast("int") + 1, F.lit(length - 1))).alias(step),
        F.col("final").alias(loss),
        F.lit(True).alias("is_padded"),
    )
    seen = history.select(run, F.col(step).cast("int").alias(step), loss, F.lit(False).alias("is_padded"))
    return seen.unionByName(missing)


def compare_runs(runs: DataFrame) -> DataFrame:
    """Side-by-side metrics with missing ones as 0, gain over the baseline and rank by accuracy.

    The rank is 1 + number of runs with a higher accuracy, from running totals over the distinct accuracies. The runs
    are computed once and stored; runs of one accuracy, such as 0 of failed ones, are dealt over SALTS keys.
    """
    filled = stored(runs.select(
        "run_id",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("accuracy", "f1", "roc_auc", "baseline_accuracy")],
    ), "runs")
    by_value = filled.groupBy("accuracy").agg(F.count(F.lit(1)).alias("n"))
    ranks = running_totals(by_value, "accuracy", {"higher": "n"}, descending=True).select(
        "accuracy", (F.col("higher") + 1).alias("accuracy_rank"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    salted = filled.withColumn("salt", F.pmod(F.xxhash64("run_id"), F.lit(SALTS)).cast("int"))
    return salted.join(ranks, ["accuracy", "salt"]).select(
        "run_id", "accuracy", "f1", "roc_auc", "baseline_accuracy",
        (F.col("accuracy") - F.col("baseline_accuracy")).alias("gain"), "accuracy_rank",
    )


def readiness(accuracy: Column, f1: Column, baseline: Column) -> Column:
    """not_ready, borderline, screening or strong; what the guide leaves open takes the best band it reaches."""
    # differences of decimal shares carry binary noise; 9 digits keep the limits inclusive
    gain = F.round(accuracy - baseline, 9)
    return (
        F.when((accuracy < ACCURACY_FLOOR) | (f1 < F1_FLOOR) | (gain < -BASELINE_MARGIN), "not_ready")
        .when((gain >= STRONG_GAIN) & (f1 > STRONG_F1), "strong")
        .when((gain >= SCREENING_GAIN) & (f1 > SCREENING_F1), "screening")
        .otherwise("borderline")
    )


def improvement_band(accuracy: Column, baseline: Column) -> Column:
    """The looser scale: below, marginal (to +5 points), good (to +15), strong."""
    gain = F.round(accuracy - baseline, 9)
    return F.when(gain < 0, "below").when(gain <= 0.05, "marginal").when(gain <= 0.15, "good").otherwise("strong")


def deployable(accuracy: Column, f1: Column) -> Column:
    return (accuracy >= DEPLOY_ACCURACY) & (f1 > DEPLOY_F1)


def run_label(dataset: Column, encoder: Column, circuit: Column, optimizer: Column) -> Column:
    parts = ((dataset, "dataset"), (encoder, "enc"), (circuit, "cir"), (optimizer, "opt"))
    return F.concat_ws(" | ", *[F.coalesce(c, F.lit(default)) for c, default in parts])
