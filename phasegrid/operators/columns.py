"""Column selection, mapping and casting; schema-level work runs no job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from phasegrid.functions.readout import blank_nulls
from phasegrid.functions.values import token_to_null

# Column names taken as the label, whatever their case.
LABEL_NAMES = (
    "label", "class", "target", "y", "outcome", "species",
    "risk_flag", "disruption_flag", "attrition_flag",
)


class MissingColumns(ValueError):
    def __init__(self, missing: list[str], available: list[str]):
        super().__init__(f"missing columns {missing}; the table has {available}")
        self.missing = missing


def missing_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Names, in their order, that the table does not have; the case counts."""
    have = set(df.columns)
    return [n for n in names if n not in have]


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(missing, df.columns)
    return df


def existing_columns(df: DataFrame, requested: Sequence[str]) -> list[str]:
    """Requested columns the table has; all of its columns when none is left."""
    return [n for n in requested if n in df.columns] or list(df.columns)


def numeric_columns(df: DataFrame, with_boolean: bool = False) -> list[str]:
    kinds = (NumericType, BooleanType) if with_boolean else (NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def infer_label(columns: Sequence[str]) -> tuple[str, list[str]]:
    """First column with a label-like name, else the last; features are all the others."""
    if not columns:
        return "", []
    label = next((c for c in columns if c.lower() in LABEL_NAMES), columns[-1])
    return label, [c for c in columns if c != label]


def default_mapping(df: DataFrame, numeric_only: bool = False) -> tuple[str, list[str]]:
    """Label = last candidate column, features = the other candidates."""
    candidates = numeric_columns(df) if numeric_only else list(df.columns)
    return (candidates[-1], candidates[:-1]) if candidates else ("", [])


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 20, blank: bool = False) -> DataFrame:
    """First rows by key (a bounded top-k, so no full sort); ``blank`` shows nulls as empty text."""
    head = df.orderBy(*order_by).limit(rows)
    return head.select(*[blank_nulls(F.col(c)).alias(c) for c in head.columns]) if blank else head


def cast_features(df: DataFrame, columns: Sequence[str], lenient: bool = False) -> DataFrame:
    """Features as doubles. A value that is no number raises, or becomes null when lenient."""
    require_columns(df, columns)
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}

    def one(name: str) -> Column:
        value = token_to_null(F.trim(F.col(name))) if name in text else F.col(name)
        return value.try_cast("double") if lenient else value.cast("double")

    return df.withColumns({c: one(c) for c in columns})


def split_names(text: Column) -> Column:
    """Comma list to trimmed names without the blank ones."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
