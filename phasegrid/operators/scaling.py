"""Imputation and scaling as fit / apply.

A fit is one aggregate over the given rows that returns one row of statistics. Applying it is a
projection with literals: no join, no shuffle, valid on batch and streaming tables alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.operators.columns import require_columns


@dataclass(frozen=True)
class Affine:
    """Per column (value - offset) / divisor * factor."""

    columns: tuple[str, ...]
    offset: tuple[float, ...]
    divisor: tuple[float, ...]
    factor: float = 1.0

    def expressions(self) -> dict[str, Column]:
        out = {}
        for c, o, d in zip(self.columns, self.offset, self.divisor, strict=True):
            scaled = (F.col(c).cast("double") - F.lit(o)) / F.lit(d)
            out[c] = scaled if self.factor == 1.0 else scaled * F.lit(self.factor)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return require_columns(df, self.columns).withColumns(self.expressions())


def _one_row(df: DataFrame, columns: Sequence[str], *stats) -> list[list[float | None]]:
    """Statistics of each column, NaN left out as null is."""
    require_columns(df, columns)
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    aggs = [s(known(c)).alias(f"s{i}_{j}") for j, c in enumerate(columns) for i, s in enumerate(stats)]
    row = df.agg(*aggs).first()
    return [[row[f"s{i}_{j}"] for j in range(len(columns))] for i in range(len(stats))]


def _known(values: list, columns: Sequence[str]) -> tuple[float, ...]:
    empty = [c for c, v in zip(columns, values) if v is None]
    if empty:
        raise ValueError(f"no values to fit on in columns {empty}")
    return tuple(float(v) for v in values)


def fit_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    (means,) = _one_row(df, columns, F.avg)
    return dict(zip(columns, _known(means, columns)))


def impute(df: DataFrame, means: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m)) for c, m in means.items()})


def fit_minmax(df: DataFrame, columns: Sequence[str], top: float = 1.0) -> Affine:
    """To [0, top]; a constant column gives 0."""
    lows, highs = _one_row(df, columns, F.min, F.max)
    low, high = _known(lows, columns), _known(highs, columns)
    width = tuple(h - o if h != o else 1.0 for o, h in zip(low, high))
    return Affine(tuple(columns), low, width, top)


def fit_angle_scale(df: DataFrame, columns: Sequence[str]) -> Affine:
    """To [0, pi] per column."""
    return fit_minmax(df, columns, math.pi)


def fit_standard(df: DataFrame, columns: Sequence[str]) -> Affine:
    """Zero mean, unit population deviation; a constant column keeps divisor 1."""
    means, deviations = _one_row(df, columns, F.avg, F.stddev_pop)
    mean, deviation = _known(means, columns), _known(deviations, columns)
    return Affine(tuple(columns), mean, tuple(d if d > 0 else 1.0 for d in deviation))


def preprocess(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean imputation and min-max to [0, 1] from one aggregate (a mean never moves the range)."""
    means, lows, highs = _one_row(df, columns, F.avg, F.min, F.max)
    low, high = _known(lows, columns), _known(highs, columns)
    width = tuple(h - o if h != o else 1.0 for o, h in zip(low, high))
    filled = impute(df, dict(zip(columns, _known(means, columns))))
    return Affine(tuple(columns), low, width).apply(filled)
