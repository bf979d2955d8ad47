"""Classification metrics as mergeable aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions.values import share
from phasegrid.operators.selection import running_totals

CLIP = 1e-15
#: Classes of the largest dense matrix.
MOST_CLASSES = 1000


def cell_counts(label: Column, prediction: Column) -> dict[str, Column]:
    """The four cells of the 2x2 matrix as conditional counts."""
    return {
        "tn": F.count_if((label == 0) & (prediction == 0)),
        "fp": F.count_if((label == 0) & (prediction == 1)),
        "fn": F.count_if((label == 1) & (prediction == 0)),
        "tp": F.count_if((label == 1) & (prediction == 1)),
    }


def log_loss_term(label: Column, probability: Column) -> Column:
    """Null unless label and probability are known (NaN is not), so that averages skip the row."""
    p = F.greatest(F.least(probability, F.lit(1 - CLIP)), F.lit(CLIP))
    known = label.isNotNull() & probability.isNotNull() & ~F.isnan(probability)
    return F.when(known, -F.when(label == 1, F.log(p)).otherwise(F.log(1 - p)))


def binary_metrics(
    df: DataFrame, label: str, prediction: str, probability: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One row per group: n, n_correct, accuracy, tn, fp, fn, tp, precision, recall, f1 (and log_loss)."""
    y, p = F.col(label), F.col(prediction)
    aggs = [
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(y == p).alias("n_correct"),
        *[c.alias(k) for k, c in cell_counts(y, p).items()],
    ]
    if probability is not None:
        aggs.append(F.avg(log_loss_term(y, F.col(probability))).alias("log_loss"))
    grouped = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return grouped.withColumns({
        "accuracy": share(F.col("n_correct"), F.col("n_samples")),
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
    })


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(accuracy, n_samples, n_correct); 0.0 for an empty table."""
    return binary_metrics(df, label, prediction).select("accuracy", "n_samples", "n_correct")


def confusion_binary(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n): all four cells, rows of the matrix are the truth."""
    wide = df.agg(*[c.alias(k) for k, c in cell_counts(F.col(label), F.col(prediction)).items()])
    cells = [
        F.struct(F.lit(t).alias("label"), F.lit(p).alias("prediction"), F.col(k).alias("n"))
        for k, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]
    return wide.select(F.inline(F.array(*cells)))


def confusion_matrix(df: DataFrame, label: str, prediction: str, n_classes: int | None = None, dense: bool = True) -> DataFrame:
    """(label, prediction, n): dense grid of n classes; highest class + 1 when not given.

    A grid of more than MOST_CLASSES classes raises; without ``dense`` only the cells that occur come, for any classes.
    """
    counts = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if not dense:
        return counts
    if n_classes is None:
        top = df.agg(F.max(F.greatest(label, prediction))).first()[0]
        n_classes = 0 if top is None else int(top) + 1
    if n_classes > MOST_CLASSES:
        raise ValueError(f"a grid of {n_classes} classes has {n_classes**2} cells; use dense=False")
    cell = F.col("id")
    grid = df.sparkSession.range(n_classes * n_classes).select(
        F.floor(cell / n_classes).cast("int").alias("label"), (cell % n_classes).cast("int").alias("prediction")
    )
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (roc_auc): share of (positive, negative) pairs ranked right, ties half; null if undefined.

    Rows whose label or score is null, or whose score is NaN, are left out. The table is read once: rows collapse to one
    per distinct score, and running totals over those place the negatives below each.
    """
    y, s = F.col(label), F.col(score).cast("double")
    rated = df.where(y.isNotNull() & s.isNotNull() & ~F.isnan(s)).select(y.alias("y"), s.alias("s"))
    by_score = rated.groupBy("s").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    placed = running_totals(by_score, "s", {"below": "neg"})
    area = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return placed.agg(F.try_divide(area, pairs).alias("roc_auc"))


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    """One row (majority_class, baseline_accuracy): always answer the most frequent class, lower class on ties."""
    classes = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return classes.agg(
        F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("majority_class"),
        share(F.max("n"), F.sum("n")).alias("baseline_accuracy"),
    )
