"""The query table and what the queries share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions.values import round_off
from phasegrid.operators.scaling import Affine, fit_standard
from phasegrid.operators.splitting import hash_split
from phasegrid.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
THETA = (0.4, 1.1, 2.0, 0.7)
THETA_XYZ = (0.4, 1.1, 2.0, 0.7, 0.3, 1.9, 2.6, 0.2, 0.9, 1.3, 2.2, 0.5)
SEED, TEST_SIZE = 42, 0.25


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def rounded(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: round_off(F.col(n), digits) for n in names})


def named(columns: Sequence[Column], prefix: str, digits: int = 6) -> list[Column]:
    return [round_off(c, digits).alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def split_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with a 0/1 label, ``is_test`` and its key columns."""
    lines = table(spark, folder, "lineitem").select(*LINE_KEY, *FEATURES, "l_linestatus")
    labelled = lines.withColumn("label", (F.col("l_linestatus") == "O").cast("int")).drop("l_linestatus")
    return hash_split(labelled, LINE_KEY, TEST_SIZE, SEED)


def line_scaler(lines: DataFrame) -> Affine:
    return fit_standard(lines.where(~F.col("is_test")), FEATURES)


def feature_columns() -> list[Column]:
    return [F.col(c) for c in FEATURES]


# SQL shared by the oracles: key, hash, split, label, train-side statistics, scaled features x0..x3.
SQL_ROW_KEY = " || ".join(f"length({c}::VARCHAR) || ':' || {c}::VARCHAR" for c in LINE_KEY)
SQL_LINES = f"""
WITH keyed AS (
  SELECT *, {SQL_ROW_KEY} AS k,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label
  FROM lineitem),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(k || '|42'), 1, 8) AS BIGINT) AS h FROM keyed),
rows_ AS (SELECT *, h / 4294967296.0 < 0.25 AS is_test FROM hashed)"""

SQL_SCALED = SQL_LINES + """,
stats AS (
  SELECT avg(l_quantity) AS m0, stddev_pop(l_quantity) AS s0, avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1,
         avg(l_discount) AS m2, stddev_pop(l_discount) AS s2, avg(l_tax) AS m3, stddev_pop(l_tax) AS s3
  FROM rows_ WHERE NOT is_test),
scaled AS (
  SELECT rows_.*, (l_quantity - m0) / s0 AS x0, (l_extendedprice - m1) / s1 AS x1,
         (l_discount - m2) / s2 AS x2, (l_tax - m3) / s3 AS x3
  FROM rows_, stats)"""

SQL_SCORED = SQL_SCALED + """,
scored AS (
  SELECT *, (1 - cos(x0 + 0.4) * cos(x1 + 1.1) * cos(x2 + 2.0) * cos(x3 + 0.7)) / 2 AS p FROM scaled)"""

SQL_ANGLES = """
WITH bounds AS (
  SELECT min(l_quantity) AS a0, max(l_quantity) AS b0, min(l_extendedprice) AS a1, max(l_extendedprice) AS b1,
         min(l_discount) AS a2, max(l_discount) AS b2, min(l_tax) AS a3, max(l_tax) AS b3
  FROM lineitem),
angles AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         (l_quantity - a0) / (b0 - a0) * pi() AS x0, (l_extendedprice - a1) / (b1 - a1) * pi() AS x1,
         (l_discount - a2) / (b2 - a2) * pi() AS x2, (l_tax - a3) / (b3 - a3) * pi() AS x3
  FROM lineitem, bounds)"""

SQL_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def sql_rounded(expressions: Sequence[str], prefix: str, digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {prefix}{i}" for i, e in enumerate(expressions))
