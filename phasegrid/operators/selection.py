"""Exact order statistics and running totals that never gather a whole group in one task.

Selections narrow a bracket: each pass is one map-side combined aggregate, and the number of passes depends on the
number of rows only, neither on their values nor on the number of groups. Group cuts stay a table; nothing that grows
with the groups reaches the driver or the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.session import stored

#: Quantiles that one pass asks for, and the sketch's accuracy: ranks are off by n / ACCURACY at most.
SHARES = [i / 512 for i in range(513)]
ACCURACY = 10_000
#: Values of the last bracket that are listed on the driver.
LISTED = 10_000
#: Hex digits of the hash: 8 in all, the first HIGH of them in the first pass.
DIGITS, HIGH = 8, 3
PART = "__part"


def exact_median(df: DataFrame, column: str) -> float | None:
    """Interpolating median of the values that are neither null nor NaN.

    Spark's own ``median`` keeps every distinct value of the column in one task. Here quantiles of a sketch, whose rank
    error is bounded, bracket the middle ranks; exact counts of what lies below and inside confirm it, and the next pass
    sketches the bracket. A pass leaves less than 1 row in 200, so 10^12 rows take five passes whatever their scale;
    once a bracket holds few rows its values are counted one by one. Equal values at a border are counted apart, so a
    value that many rows share cannot keep a bracket wide.
    """
    v = F.col("v")
    values = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v))
    n, marks = values.agg(F.count("v"), F.percentile_approx("v", SHARES, ACCURACY)).first()
    if not n:
        return None
    first, second = (n - 1) // 2, n // 2
    before, size, ends = 0, n, (marks[0], marks[-1])
    while True:
        slack = 2 / ACCURACY + 1 / size
        i = math.floor(((first - before) / size - slack) * 512)
        j = math.ceil(((first - before) / size + slack) * 512)
        low, high = marks[i] if i >= 0 else ends[0], marks[j] if j <= 512 else ends[1]
        if size * ((j - i) / 512 + 2 * slack) <= LISTED or low == high:
            return _listed(values, low, high, first, second)
        inside = (v > low) & (v < high)
        row = values.agg(
            F.count_if(v < low).alias("below"), F.count_if(v == low).alias("at_low"), F.count_if(inside).alias("inside"),
            F.count_if(v == high).alias("at_high"), F.percentile_approx(F.when(inside, v), SHARES, ACCURACY).alias("marks"),
        ).first()
        start, end = row["below"] + row["at_low"], row["below"] + row["at_low"] + row["inside"]
        if first < start:
            low, high = (low, low) if first >= row["below"] else (ends[0], low)
        elif first >= end:
            low, high = (high, high) if first < end + row["at_high"] else (high, ends[1])
        else:
            before, size, marks, ends = start, row["inside"], row["marks"], (low, high)
            continue
        return _listed(values, low, high, first, second)


def _listed(values: DataFrame, low: float, high: float, first: int, second: int) -> float:
    """Mean of the values at two neighbouring ranks of which the first lies within [low, high]."""
    v = F.col("v")
    side = F.when(v < low, -1).when(v > high, 1).otherwise(0)
    cells = values.groupBy(side.alias("side"), F.when(side == 0, v).alias("value")).agg(F.count("v").alias("n"), F.min("v").alias("least"))
    found, upto = [], 0
    for cell in sorted(cells.collect(), key=lambda c: (c["side"], c["least"])):
        upto += cell["n"]
        found += [cell["least"] for rank in (first, second)[len(found) :] if rank < upto]
    return found[0] if found[0] == found[1] else (found[0] + found[1]) / 2


def digit_counts(rows: DataFrame) -> DataFrame:
    """(g, b, n): rows of each group by the upper digits of their hash, at most 4,096 cells a group; stored.

    ``rows`` has g (group), h (8 hex digits) and k (key); a null group has no cells.
    """
    cells = rows.where("g IS NOT NULL").groupBy("g", F.substring("h", 1, HIGH).alias("b")).agg(F.count("h").alias("n"))
    return stored(cells, "digits")


def lowest_cuts(rows: DataFrame, counts: DataFrame, wanted: Column) -> DataFrame:
    """(g, h, k) per group: the lowest ``wanted`` rows by (hash, key) are those below h, or at h with a key up to k.

    ``wanted`` is an expression of ``g`` and of ``size``, the group's rows; more than there are takes all. Radix
    selection: the counts say which upper digits hold the cut, a second pass counts the hashes below those digits, and
    where several keys share the cut hash a third counts those keys; a null k takes them all. Equal keys stay on one side.
    Groups with nothing wanted have no cut. The passes join rows with cuts on (group, digits), which spreads a large group.
    """
    sized = counts.withColumn("size", F.sum("n").over(Window.partitionBy("g"))).withColumn("want", F.least(wanted.cast("long"), F.col("size")))
    upper = stored(_crossing(sized, "b", F.col("want")), "upper")
    named = rows.where("g IS NOT NULL").withColumn("b", F.substring("h", 1, HIGH))
    inside = named.join(upper.where("need < n").select("g", "b", "need"), ["g", "b"])
    lower = stored(_crossing(inside.groupBy("g", "h").agg(F.count("h").alias("n"), F.first("need").alias("want")), "h", F.col("want")), "lower")
    tied = rows.join(lower.where("need < n").select("g", "h", "need"), ["g", "h"])
    keys = _crossing(tied.groupBy("g", "h", "k").agg(F.count("h").alias("n"), F.first("need").alias("want")), "k", F.col("want"))
    whole = F.concat(F.col("b"), F.lit("f" * (DIGITS - HIGH)))
    none = F.lit(None).cast(rows.schema["k"].dataType).alias("k")
    return (
        upper.where("need = n").select("g", whole.alias("h"), none)
        .unionByName(lower.where("need = n").select("g", "h", none))
        .unionByName(keys.select("g", "h", "k"))
    )


def _crossing(cells: DataFrame, order: str, want: Column) -> DataFrame:
    """The cell of each group in which the running count reaches what is wanted, and how many of it are needed."""
    running = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cells.withColumn("upto", F.sum("n").over(running))
        .where((want > 0) & (F.col("upto") >= want) & (F.col("upto") - F.col("n") < want))
        .withColumn("need", want - F.col("upto") + F.col("n")).drop("upto", "want", "size")
    )


def among_lowest(
    df: DataFrame, group: str, hash_column: str, key: str, cuts: DataFrame, flag: str, counts: DataFrame | None = None,
) -> DataFrame:
    """Add whether a row is among the lowest of its group; false for a group without a cut.

    Rows meet the cuts by group and upper digits of their hash: each cell of ``counts`` (g, b, as ``digit_counts`` gives
    them; else taken from the rows) says whether its rows all fall below the cut, all above, or are compared one by one.
    So a group that holds very many rows is dealt over its cells, not read by one task; few cells are broadcast.
    """
    b = F.substring(F.col(hash_column), 1, HIGH)
    if counts is None:
        counts = df.select(F.col(group).alias("g"), b.alias("b")).where("g IS NOT NULL").distinct()
    cut_b = F.substring("__cut", 1, HIGH)
    cells = (
        counts.select("g", "b").join(cuts.select("g", F.col("h").alias("__cut"), F.col("k").alias("__upto")), "g")
        .withColumn("__side", F.when(F.col("b") < cut_b, 1).when(F.col("b") > cut_b, -1).otherwise(0))
        .select(F.col("g").alias(group), F.col("b").alias("__b"), "__side", "__cut", "__upto")
    )
    h, k = F.col(hash_column), F.col(key)
    low = (h < F.col("__cut")) | ((h == F.col("__cut")) & (F.col("__upto").isNull() | (k <= F.col("__upto"))))
    taken = F.when(F.col("__side") == 1, True).when(F.col("__side") == -1, False).otherwise(low)
    joined = df.withColumn("__b", b).join(cells, [group, "__b"], "left")
    return joined.withColumn(flag, F.coalesce(taken, F.lit(False))).drop("__b", "__side", "__cut", "__upto")


def running_totals(df: DataFrame, order: str, totals: dict[str, str], descending: bool = False) -> DataFrame:
    """Add, for each new name, the total of a column over the rows that stand strictly before by ``order``.

    Values of ``order`` are distinct. Two levels: rows are dealt by ranges of the order and stored with the number of
    their range, each range adds up for itself, and the ranges' totals, one row for each, are added up and joined back.
    No task holds more than its range; the number of ranges is that of Spark's shuffle partitions.
    """
    by = F.desc(order) if descending else F.asc(order)
    laid = stored(df.repartitionByRange(by).withColumn(PART, F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy(PART).agg(*[F.sum(c).alias(n) for n, c in totals.items()]).select(
        PART, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in totals]
    )
    within = Window.partitionBy(PART).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    summed = laid.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in totals.items()})
    # a row for each shuffle partition
    joined = summed.join(F.broadcast(ranges), PART)
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in totals}).drop(PART, *[f"__{n}" for n in totals])
