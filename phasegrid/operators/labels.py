"""Binary labels from any label column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from phasegrid.operators.columns import require_columns
from phasegrid.operators.selection import exact_median

LISTED_CLASSES = 20


@dataclass(frozen=True)
class LabelRule:
    """How a column becomes 0/1: ``as_is``, ``above`` a number, or ``equals`` the positive class."""

    column: str
    kind: str
    value: float | str | None = None

    def expression(self) -> Column:
        c = F.col(self.column)
        if self.kind == "as_is":
            return c.cast("int")
        if self.kind == "above":
            return (c > F.lit(self.value)).cast("int")
        return (c == F.lit(self.value)).cast("int")


def fit_label(df: DataFrame, column: str) -> LabelRule:
    """0/1 stays; other numbers split strictly above the median; two text classes split by order.

    Null labels stay null. Anything but two text classes raises and lists the classes found.
    """
    require_columns(df, [column])
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, BooleanType):
        return LabelRule(column, "as_is")
    if isinstance(kind, NumericType):
        other = df.agg(F.count_if(c.isNotNull() & ~c.cast("double").isin(0.0, 1.0))).first()[0]
        if other == 0:
            return LabelRule(column, "as_is")
        return LabelRule(column, "above", exact_median(df, column))
    found = df.where(c.isNotNull()).select(c.cast("string").alias("c")).distinct().limit(LISTED_CLASSES + 1)
    classes = sorted(r["c"] for r in found.collect())
    if len(classes) != 2:
        more = " and more" if len(classes) > LISTED_CLASSES else ""
        raise ValueError(f"{column!r} must hold two classes, found {classes[:LISTED_CLASSES]}{more}")
    return LabelRule(column, "equals", classes[-1])


def label_verdict(df: DataFrame, column: str) -> DataFrame:
    """(n_classes, smallest, largest, is_binary): the check behind ``fit_label`` as a table."""
    c = F.col(column).cast("string")
    classes = df.where(c.isNotNull()).groupBy(c.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return classes.agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("c").alias("smallest"), F.max("c").alias("largest")
    ).withColumn("is_binary", F.col("n_classes") == 2)
