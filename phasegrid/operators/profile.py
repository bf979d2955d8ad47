"""Column profiles, class balance and data-suitability checks.

Each profile is one pass over the table: all numeric columns share one aggregate, all categorical
columns share one grouped count. There is no cap on the number of rows or columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.operators.columns import column_types, numeric_columns, require_columns
from phasegrid.session import stored

#: Relative standard error of distinct counts, and items a frequency sketch tracks.
DISTINCT_ERROR, TRACKED = 0.01, 10_000
#: Rows that values are measured from in correlations.
ANCHOR_ROWS = 100
#: Columns of a block whose products a task holds at once.
BLOCK_COLUMNS = 1000


def _stack(rows: list[tuple], names: Sequence[str]) -> Column:
    """Turn one wide row into long rows: an inlined array of structs."""
    return F.inline(F.array(*[F.struct(*[v.alias(n) for n, v in zip(names, row)]) for row in rows]))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, mean, std, min, max, null_count, n_rows), half-even rounded to 4 digits."""
    require_columns(df, columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            F.count_if(v.isNull()).alias(f"nulls{i}"),
        ]
    wide = df.select(*columns).agg(*aggs)
    rows = [
        (
            F.lit(c),
            *[F.bround(F.col(f"{s}{i}"), 4) for s in ("mean", "std", "min", "max")],
            F.col(f"nulls{i}"),
            F.col("n"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(_stack(rows, ("column_name", "mean", "std", "min", "max", "null_count", "n_rows")))


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n), one row per distinct value; map-side counts absorb the row blow-up."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], list(columns), "column_name", "value").groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def categorical_profile(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """(column_name, value_rank, value, n): the most frequent values of each column, ties by value.

    The row_number filter lets Spark keep only ``top`` rows per column in each task before the
    shuffle, so a key-like column sends no more than a flag column.
    """
    require_columns(df, columns)
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return (
        _value_counts(df, columns)
        .where(F.col("value").isNotNull())
        .withColumn("value_rank", F.row_number().over(order))
        .where(F.col("value_rank") <= top)
        .select("column_name", "value_rank", "value", "n")
    )


def categorical_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_distinct, null_count), exact."""
    require_columns(df, columns)
    known = F.col("value").isNotNull()
    return _value_counts(df, columns).groupBy("column_name").agg(
        F.count_if(known).alias("n_distinct"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_count"),
    )


VALUE_PROFILE = (
    "column_name string, is_approximate boolean, n_distinct bigint, null_count bigint, value_rank int, value string, n bigint, "
    "distinct_error double, count_error bigint"
)


def value_profile(df: DataFrame, columns: Sequence[str], top: int = 5, key_share: float = 0.5, least_keys: int = 1000) -> DataFrame:
    """Distinct count, nulls and most frequent values of each column in one table, exact except for key-like columns.

    One pass sketches every column: distinct values (relative standard error DISTINCT_ERROR) and frequent items. Columns
    with more distinct values than ``key_share`` of their rows, and than ``least_keys``, are key-like: counting their
    values would shuffle about every row for a list that says nothing. Their figures come from the sketches; a value's
    count is off by ``count_error`` at most. The values of all others are counted exactly in one shuffle, stored, and
    both the summary and the top values read that. A column without values has one row without a value.
    """
    require_columns(df, columns)
    text = [F.col(c).cast("string") for c in columns]
    sketches = [F.count(F.lit(1)).alias("rows")]
    for i, v in enumerate(text):
        sketches += [
            F.count(v).alias(f"known{i}"), F.approx_count_distinct(v, DISTINCT_ERROR).alias(f"distinct{i}"),
            F.call_function("approx_top_k", v, F.lit(top), F.lit(TRACKED)).alias(f"items{i}"),
        ]
    row = df.agg(*sketches).first()
    exact, rough = [], []
    for i, c in enumerate(columns):
        known, distinct = row[f"known{i}"], min(row[f"distinct{i}"], row[f"known{i}"])
        if distinct <= max(least_keys, key_share * known):
            exact.append(c)
            continue
        items = sorted(((x["item"], x["count"]) for x in row[f"items{i}"] if x["item"] is not None), key=lambda x: (-x[1], x[0]))
        error = int(3.5 * known / TRACKED)
        rough += [
            (c, True, distinct, row["rows"] - known, k + 1, v, n, DISTINCT_ERROR, error) for k, (v, n) in enumerate(items[:top])
        ] or [(c, True, distinct, row["rows"] - known, None, None, None, DISTINCT_ERROR, error)]
    out = df.sparkSession.createDataFrame(rough, VALUE_PROFILE)
    if not exact:
        return out
    counts = stored(_value_counts(df, exact), "values")
    given = F.col("value").isNotNull()
    summary = counts.groupBy("column_name").agg(
        F.count_if(given).alias("n_distinct"), F.coalesce(F.sum(F.when(~given, F.col("n"))), F.lit(0)).alias("null_count")
    )
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    ranked = counts.where(given).withColumn("value_rank", F.row_number().over(order)).where(F.col("value_rank") <= top)
    named = df.sparkSession.createDataFrame([(c,) for c in exact], "column_name string").join(summary, "column_name", "left").join(ranked, "column_name", "left")
    return out.unionByName(named.select(
        "column_name", F.lit(False).alias("is_approximate"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        F.coalesce("null_count", F.lit(0)).alias("null_count"), "value_rank", "value", "n",
        F.lit(0.0).alias("distinct_error"), F.lit(0).cast("bigint").alias("count_error"),
    ))


def column_report(df: DataFrame) -> DataFrame:
    """(column_name, type_name, is_numeric, null_count, n_rows) for every column."""
    numeric = set(numeric_columns(df))
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        (F.lit(c), F.lit(t), F.lit(c in numeric), F.col(f"nulls{i}"), F.col("n"))
        for i, (c, t) in enumerate(column_types(df).items())
    ]
    return wide.select(_stack(rows, ("column_name", "type_name", "is_numeric", "null_count", "n_rows")))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """(value, n, n_rows, n_missing_label), one row per non-null class."""
    require_columns(df, [label])
    counts = stored(df.groupBy(F.col(label).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")), "classes")
    # totals of the counts, as scalar subqueries: the table is read once and its classes are never gathered in one task
    missing = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    totals = counts.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), missing.alias("missing")))
    return counts.where(F.col("value").isNotNull()).withColumn("totals", totals.scalar()).select(
        "value", "n", F.col("totals.rows").alias("n_rows"), F.col("totals.missing").alias("n_missing_label")
    )


def dataset_summary(df: DataFrame, features: Sequence[str], label: str, is_test: str) -> DataFrame:
    """One row: sizes and positive rates of the two sides of a split."""
    test, y = F.col(is_test), F.col(label).cast("double")
    return df.agg(
        F.count_if(~test).alias("n_train"),
        F.count_if(test).alias("n_test"),
        F.avg(F.when(~test, y)).alias("train_positive_rate"),
        F.avg(F.when(test, y)).alias("test_positive_rate"),
    ).select(
        F.lit(len(features)).alias("feature_count"),
        F.array(*[F.lit(c) for c in features]).alias("feature_columns"),
        F.lit(label).alias("label_column"),
        "n_train", "n_test", "train_positive_rate", "test_positive_rate",
    )


def suitability(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(rule, observed, status) rows of the training-table guide, from one aggregate.

    Row bands are half-open; 300 to 500 rows, which the guide leaves open, count as very good.
    """
    require_columns(df, [*features, label])
    y = F.col(label).cast("double")
    nulls = F.lit(0)
    for c in [*features, label]:
        nulls = nulls + F.col(c).isNull().cast("int")
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"),
        F.count_if(y.isNull() | ~y.isin(0.0, 1.0)).alias("odd"),
        F.avg(F.when(y.isin(0.0, 1.0), y)).alias("rate"),
    )
    n, k = F.col("n"), len(features)
    row_band = (
        F.when(n < 60, "too_few").when(n < 80, "marginal").when(n < 150, "good")
        .when(n <= 500, "very_good").otherwise("slow_sample_advised")
    )
    feature_band = "few" if k < 3 else "fast" if k <= 4 else "balanced" if k <= 6 else "slow" if k <= 8 else "too_many"
    ok = lambda test: F.when(test, "ok").otherwise("violated")
    rows = [
        (F.lit("row_count"), n.cast("double"), row_band),
        (F.lit("feature_count"), F.lit(float(k)), F.lit(feature_band)),
        (F.lit("no_missing_values"), F.col("nulls").cast("double"), ok(F.col("nulls") == 0)),
        (F.lit("label_is_0_or_1"), F.col("odd").cast("double"), ok(F.col("odd") == 0)),
        (F.lit("class_balance"), F.col("rate"), ok(F.coalesce(F.col("rate").between(0.4, 0.6), F.lit(False)))),
    ]
    return wide.select(_stack(rows, ("rule", "observed", "status")))


def _moments(features: int, anchors: Sequence[float], left: range, right: range):
    """Per task and pair of columns the sums that a correlation over their common rows needs, as matrix products.

    Values are taken less their column's anchor, a value near them, so that large values lose no digits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(left), len(right)))
        for batch in batches:
            cells = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            for start in range(0, len(cells), 8192):
                part = cells[start : start + 8192]
                known = ~np.isnan(part)
                x = np.where(known, part - anchors, 0.0)
                a, ka, b, kb = x[:, left], known[:, left].astype(float), x[:, right], known[:, right].astype(float)
                sums += [ka.T @ kb, a.T @ kb, ka.T @ b, (a * a).T @ kb, ka.T @ (b * b), a.T @ b]
        pairs = [(k, m) for k, i in enumerate(left) for m, j in enumerate(right) if i < j]
        if pairs:
            at = np.array(pairs).T
            names = [pa.array(np.asarray(side)[index].astype(np.int32)) for side, index in ((left, at[0]), (right, at[1]))]
            yield pa.RecordBatch.from_arrays([*names, *[pa.array(v[at[0], at[1]]) for v in sums]], schema=MOMENT_SCHEMA)

    return run


MOMENTS = "i int, j int, n double, x double, y double, xx double, yy double, xy double"
MOMENT_SCHEMA = pa.schema([(f.split(" ")[0], pa.int32() if f.endswith(" int") else pa.float64()) for f in MOMENTS.split(", ")])


def correlated_pairs(df: DataFrame, features: Sequence[str], threshold: float) -> DataFrame:
    """(feature_a, feature_b, r) for the pairs with |r| at or above the threshold.

    Each pair counts the rows in which both are known; NaN is unknown. One scan for up to BLOCK_COLUMNS columns: a task
    multiplies its rows' column blocks and sends one row of sums for each pair, which Spark adds up; the plan does not
    grow with the pairs. A wider table takes a scan for each pair of blocks. Constant columns have no correlation.
    """
    require_columns(df, features)
    spark, width = df.sparkSession, len(features)
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(features)])
    # any value near a column's serves: a few rows give one, and the result does not depend on which
    near = numbers.limit(ANCHOR_ROWS).toPandas().astype(float).mean()
    anchors = np.where(np.isfinite(near), near, 0.0)
    blocks = [range(a, min(a + BLOCK_COLUMNS, width)) for a in range(0, width, BLOCK_COLUMNS)]
    out = spark.createDataFrame([], MOMENTS)
    for k, left in enumerate(blocks):
        for right in blocks[k:]:
            out = out.unionByName(numbers.mapInArrow(_moments(width, anchors, left, right), MOMENTS))
    total = out.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    vary_x, vary_y = (F.col(s + s) - F.col(s) * F.col(s) / F.col("n") for s in "xy")
    # what rounding leaves of a constant column is no variance
    varied = (vary_x > F.col("xx") * 1e-14) & (vary_y > F.col("yy") * 1e-14)
    ratio = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(vary_x * vary_y)
    r = F.when(varied, F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0)))
    names = F.array(*[F.lit(c) for c in features]) if width else F.array().cast("array<string>")
    return (
        total.where("n > 1").select(F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"),
                                    r.alias("r"))
        .where(F.abs("r") >= threshold)
    )


def leak_check(df: DataFrame, features: Sequence[str], label: str, threshold: float = 0.999) -> DataFrame:
    """Features that give the label away.

    (feature, abs_r, n_values, n_pure_values, is_leak): a leak has |corr| at the threshold, or each
    of its values occurs with one label only while values do repeat. (feature, value) pairs are
    counted map-side first; the correlations are one aggregate row, exact for columns of large values too.
    """
    require_columns(df, [*features, label])
    y = F.col(label).cast("double")
    x = [F.col(c).cast("double") for c in features]
    wide = df.agg(*[F.corr(c, y).alias(f"r{i}") for i, c in enumerate(x)])
    r = wide.select(_stack([(F.lit(c), F.abs(F.col(f"r{i}"))) for i, c in enumerate(features)], ("feature", "abs_r")))
    long = (
        df.select(y.alias("y"), *[c.alias(name) for c, name in zip(x, features)])
        .unpivot(["y"], list(features), "feature", "v")
        .where(F.col("v").isNotNull() & F.col("y").isNotNull())
    )
    by_value = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    sums = by_value.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("lo") == F.col("hi")).alias("n_pure_values"), F.sum("n").alias("n"),
    )
    pure = (F.col("n_pure_values") == F.col("n_values")) & (F.col("n_values") < F.col("n"))
    return sums.join(r, "feature").select(
        "feature", "abs_r", "n_values", "n_pure_values",
        (F.coalesce(F.col("abs_r") >= threshold, F.lit(False)) | pure).alias("is_leak"),
    )
