"""Deterministic splits and samples by key hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.functions.hashing import fast_below, hash_below, hash_hex, row_key
from phasegrid.operators.selection import among_lowest, digit_counts, lowest_cuts

KEY, HASH, GROUP = "__key", "__hash", "__group"


def hash_split(
    df: DataFrame, key: Sequence[str], test_size: float = 0.25, seed: int = 42, method: str = "md5"
) -> DataFrame:
    """Add ``is_test`` by hash threshold: a projection, each class split at the same share in expectation.

    ``md5`` can be repeated in any engine, ``xxhash64`` costs a tenth.
    """
    if method not in ("md5", "xxhash64"):
        raise ValueError(f"method is {method!r}, not 'md5' or 'xxhash64'")
    below = fast_below(key, seed, test_size) if method == "xxhash64" else hash_below(row_key(key), seed, test_size)
    return df.withColumn("is_test", below)


def _hashed(df: DataFrame, key: Sequence[str], seed: int, group) -> DataFrame:
    return df.withColumn(KEY, row_key(key)).withColumns({HASH: hash_hex(F.col(KEY), seed), GROUP: group})


def _rows(hashed: DataFrame) -> DataFrame:
    return hashed.select(F.col(GROUP).alias("g"), F.col(HASH).alias("h"), F.col(KEY).alias("k"))


def exact_split(df: DataFrame, key: Sequence[str], label: str, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``is_test`` with exactly the rounded share of rows, per class when there are two classes.

    Otherwise the table is split as one group. Rows of a null label stay in training. The table is read three times:
    to count the rows by the upper digits of their hashes, which also tells classes and sizes, to count within the
    digits of the cut, and to mark the rows.
    """
    hashed = _hashed(df, key, seed, F.col(label))
    counts = digit_counts(_rows(hashed))
    if counts.select("g").distinct().count() != 2:
        hashed = hashed.withColumn(GROUP, F.when(F.col(label).isNotNull(), 0))
        counts = counts.groupBy(F.lit(0).alias("g"), "b").agg(F.sum("n").alias("n"))
    cuts = lowest_cuts(_rows(hashed), counts, F.floor(F.col("size") * test_size + 0.5))
    return among_lowest(hashed, GROUP, HASH, KEY, cuts, "is_test", counts).drop(KEY, HASH, GROUP)


def balanced_sample(df: DataFrame, key: Sequence[str], label: str, rows: int = 300, seed: int = 42) -> DataFrame:
    """The same number of rows of each class, lowest hashes first; a smaller class comes whole.

    What does not divide evenly goes to the first classes in their order, one row each. Any number of classes.
    """
    hashed = _hashed(df, key, seed, F.col(label))
    counts = digit_counts(_rows(hashed))
    classes = counts.select("g").distinct()
    each, rest = divmod(rows, max(1, classes.count()))
    wanted = F.lit(each)
    if rest:
        last = classes.orderBy("g").offset(rest - 1).limit(1).first()[0]
        wanted = wanted + (F.col("g") <= F.lit(last)).cast("int")
    cuts = lowest_cuts(_rows(hashed), counts, wanted)
    return among_lowest(hashed, GROUP, HASH, KEY, cuts, "__taken", counts).where("__taken").drop(KEY, HASH, GROUP, "__taken")
