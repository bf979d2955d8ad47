"""Measured bitstring counts: expectations, dense distributions and parity.

Input is a long table (sample, bitstring, count). Repeated bitstrings of a sample are summed
map-side before the shuffle, so a sample that holds much of the table costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(df: DataFrame, count: str) -> Column:
    return F.col(count).cast("long")


def _index(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("long")


def z_expectation(df: DataFrame, sample: str, bits: str, count: str, n_qubits: int) -> DataFrame:
    """(sample, qubit, expectation); qubit 0 is the low (rightmost) bit of the string.

    One signed sum per qubit in a single grouped aggregate; the rows are not multiplied by qubits.
    """
    n = _count(df, count)
    sums = df.groupBy(sample).agg(
        F.sum(n).alias("total"),
        *[
            F.sum(F.when(F.substring(bits, -1 - q, 1) == "1", -n).otherwise(n)).alias(f"z{q}")
            for q in range(n_qubits)
        ],
    )
    cells = [
        F.struct(F.lit(q).alias("qubit"), F.try_divide(F.col(f"z{q}").cast("double"), F.col("total")).alias("expectation"))
        for q in range(n_qubits)
    ]
    return sums.select(sample, F.inline(F.array(*cells)))


def distribution(df: DataFrame, sample: str, bits: str, count: str, n_qubits: int) -> DataFrame:
    """(sample, probabilities): dense vector of 2**n shares, index read from the reversed string.

    Strings beyond the vector count in the total only. After the first sum a sample has at most
    2**n + 1 cells, so the map built per sample is bounded by the circuit width.
    """
    size = 1 << n_qubits
    index = _index(F.reverse(F.col(bits)))
    cell = F.when(index < size, index).otherwise(F.lit(-1))
    cells = df.groupBy(sample, cell.alias("cell")).agg(F.sum(_count(df, count)).alias("n"))
    maps = cells.groupBy(sample).agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("by_cell")
    )
    dense = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")),
        lambda i: F.coalesce(F.try_divide(F.col("by_cell")[i].cast("double"), F.col("total")), F.lit(0.0)),
    )
    return maps.select(sample, dense.alias("probabilities"))


def parity_readout(df: DataFrame, sample: str, bits: str, count: str) -> DataFrame:
    """(sample, p_even, p_odd): class probabilities by the exclusive-or of all bits."""
    n, odd = _count(df, count), F.length(F.replace(F.col(bits), F.lit("0"), F.lit(""))) % 2 == 1
    sums = df.groupBy(sample).agg(
        F.sum(n).alias("total"), F.coalesce(F.sum(F.when(odd, n)), F.lit(0)).alias("odd")
    )
    p_odd = F.try_divide(F.col("odd").cast("double"), F.col("total"))
    return sums.select(sample, (F.lit(1.0) - p_odd).alias("p_even"), p_odd.alias("p_odd"))
