"""Missing values, rounding and small expression helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# The text tokens a CSV reader of the pandas kind takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Make NaN a null, once, so that every later aggregate skips it."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType))]
    wanted = set(floating if columns is None else columns)
    hit = {c: F.when(~F.isnan(c), F.col(c)) for c in floating if c in wanted}
    return df.withColumns(hit) if hit else df


def token_to_null(text: Column) -> Column:
    """Null where the text is one of the missing tokens."""
    return F.when(~text.isin(*MISSING_TOKENS), text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column used inside a lambda is otherwise evaluated again for each element of the array.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def product(factors: list[Column]) -> Column:
    return reduce(mul, factors) if factors else F.lit(1.0)


def total(terms: list[Column]) -> Column:
    return reduce(add, terms) if terms else F.lit(0.0)


def round_off(value: Column, digits: int = 6) -> Column:
    """Rounded value with the sign of zero dropped."""
    return F.round(value, digits) + F.lit(0.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 (the zero_division=0 convention)."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
