"""Row-level readouts: classes, labels, bands and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest score; the first one where several are equal."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_class(scores: Column, n_classes: int) -> Column:
    return argmax(scores) % F.lit(n_classes)


def class_from_probability(probability: Column) -> Column:
    """Most probable of two classes; an exact tie goes to the first class, as argmax has it."""
    return F.when(~F.isnan(probability), (probability > 0.5).cast("int"))


def risk_label(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit("HIGH RISK")).when(prediction.isNotNull(), F.lit("low risk"))


def confidence_band(probability: Column) -> Column:
    return (
        F.when(probability.isNull() | F.isnan(probability), F.lit(None).cast("string"))
        .when(probability > 0.75, F.lit("act_first"))
        .when(probability >= 0.5, F.lit("manual_review"))
        .otherwise(F.lit("low"))
    )


def percent_text(value: Column) -> Column:
    """Shares up to 1 are shown as percent, larger numbers as percent already."""
    scaled = F.when(value <= 1, value * 100).otherwise(value)
    return F.when(value.isNull(), F.lit("--")).otherwise(F.format_string("%.1f%%", scaled))


def number_text(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNull(), F.lit("--")).otherwise(F.format_string(f"%.{digits}f", value))


def blank_nulls(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))
