"""CSV reading and writing.

Cells are read as text first, so that all usual missing tokens (not just one) become null; the
types then come from the caller's schema or from one inference aggregate over the whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from phasegrid.functions.values import token_to_null

CORRUPT = "_corrupt_record"


class EmptyTable(ValueError):
    pass


def _text_schema(spark: SparkSession, path: str, **options) -> StructType:
    # reads the header only
    return spark.read.csv(path, header=True, inferSchema=False, **options).schema


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, on_malformed: str = "raise", multi_line: bool = False,
) -> DataFrame:
    """Header CSV to a typed table.

    ``on_malformed``: ``raise`` fails the job on a row whose number of cells is off; ``keep`` keeps
    such rows and their text in ``_corrupt_record``. A quote inside quotes is doubled; ``multi_line`` allows line
    breaks there, at the price of files that cannot be split. With a schema the read is one lazy scan;
    without one the types are inferred from all rows. A cell that does not fit its type raises.
    """
    if on_malformed not in ("raise", "keep"):
        raise ValueError(f"on_malformed is {on_malformed!r}, not 'raise' or 'keep'")
    dialect = {"escape": '"', "multiLine": multi_line}
    text = _text_schema(spark, path, **dialect)
    names = text.fieldNames()
    reader = spark.read.option("header", True).option("enforceSchema", False).options(**dialect)
    if on_malformed == "raise":
        # unpruned: a pruned parse does not look at surplus cells
        rows = reader.option("columnPruning", False).option("mode", "FAILFAST").schema(text).csv(path)
    else:
        wide = StructType(list(text.fields)).add(CORRUPT, "string")
        rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(wide).csv(path)
    rows = rows.withColumns({c: token_to_null(F.col(c)) for c in names})
    types = _given_types(schema, names) if schema is not None else infer_types(rows, names)
    return rows.withColumns({c: F.col(c).cast(types[c]) for c in names})


def _given_types(schema: StructType | str, names: list[str]) -> dict[str, str]:
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if schema.fieldNames() != names:
        raise ValueError(f"schema names {schema.fieldNames()} differ from the header {names}")
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def infer_types(rows: DataFrame, names: list[str]) -> dict[str, str]:
    """bigint, double, boolean or string per text column; whole numbers with gaps are doubles."""
    tests = {}
    for i, c in enumerate(names):
        v = F.col(c)
        tests[f"n{i}"] = F.count(v)
        tests[f"nulls{i}"] = F.count_if(v.isNull())
        # "1.5" also casts to bigint, so a whole number is told by its digits
        tests[f"int{i}"] = F.count_if(v.rlike(r"^\s*[+-]?\d+\s*$") & v.try_cast("bigint").isNotNull())
        tests[f"real{i}"] = F.count(v.try_cast("double"))
        tests[f"flag{i}"] = F.count_if(F.lower(v).isin("true", "false"))
    found = rows.agg(*[t.alias(k) for k, t in tests.items()]).first()
    out = {}
    for i, c in enumerate(names):
        n, gaps = found[f"n{i}"], found[f"nulls{i}"]
        if n and found[f"int{i}"] == n:
            out[c] = "double" if gaps else "bigint"
        elif n == 0 or found[f"real{i}"] == n:
            out[c] = "double"
        else:
            out[c] = "boolean" if found[f"flag{i}"] == n and not gaps else "string"
    return out


def read_nonempty(spark: SparkSession, path: str, **options) -> DataFrame:
    df = read_csv(spark, path, **options)
    if df.isEmpty():
        raise EmptyTable(f"no rows in {path}")
    return df


def parse_lines(df: DataFrame, line: str, schema: str) -> DataFrame:
    """CSV lines held in a column to columns, plus ``_corrupt_record`` for the lines that do not fit."""
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_csv(F.col(line), f"{schema}, {CORRUPT} string", options)
    return df.withColumn("__row", parsed).select(*[c for c in df.columns if c != line], "__row.*")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All rows, header, every value quoted; nulls as empty text."""
    df.write.csv(path, header=True, quoteAll=True, nullValue="", emptyValue="", escape='"', mode=mode)
