"""Labels, imputation, scaling, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.functions.encoding import row_angles
from phasegrid.operators import labels as L
from phasegrid.operators import scaling as S
from phasegrid.operators import splitting as X
from phasegrid.queries.profiling import _SQL_GAPS, events_with_gaps
from phasegrid.queries.registry import (
    FEATURES, LINE_KEY, SQL_ANGLES, SQL_KEYS, SQL_LINES, SQL_SCALED, feature_columns, line_scaler, named, query,
    rounded, split_lines, sql_rounded,
)
from phasegrid.sources.tables import table


@query("label_passthrough", "SELECT doc_id, quality AS label FROM labels")
def label_passthrough(spark, folder):
    labels = table(spark, folder, "labels")
    return labels.select("doc_id", L.fit_label(labels, "quality").expression().alias("label"))


@query("label_median", "SELECT event_id, CASE WHEN value > (SELECT median(value) FROM events) THEN 1 ELSE 0 END AS label FROM events")
def label_median(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", L.fit_label(events, "value").expression().alias("label"))


_SQL_WIDE = "(SELECT event_id, value * pow(2.0, event_id % 1400 - 700) AS value FROM events)"


@query("label_median_wide", f"SELECT event_id, CASE WHEN value > (SELECT median(value) FROM {_SQL_WIDE}) THEN 1 ELSE 0 END AS label FROM {_SQL_WIDE}")
def label_median_wide(spark, folder):
    """Values over 420 decimal scales."""
    scaled = F.col("value") * F.pow(F.lit(2.0), (F.col("event_id") % 1400 - 700).cast("double"))
    events = table(spark, folder, "events").select("event_id", scaled.alias("value"))
    return events.select("event_id", L.fit_label(events, "value").expression().alias("label"))


@query("label_string", f"SELECT {SQL_KEYS}, CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1 ELSE 0 END AS label FROM lineitem")
def label_string(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(*LINE_KEY, L.fit_label(lines, "l_linestatus").expression().alias("label"))


_VERDICTS = (("orders", "o_orderstatus"), ("lineitem", "l_linestatus"), ("customer", "c_mktsegment"))


@query("label_verdict", " UNION ALL ".join(
    f"SELECT '{c}' AS label_column, count(DISTINCT {c}) AS n_classes, min({c}) AS smallest, max({c}) AS largest, "
    f"count(DISTINCT {c}) = 2 AS is_binary FROM {t}" for t, c in _VERDICTS
))
def label_verdict(spark, folder):
    out = None
    for t, c in _VERDICTS:
        part = L.label_verdict(table(spark, folder, t), c).select(F.lit(c).alias("label_column"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("impute_mean", f"WITH t AS (SELECT * FROM {_SQL_GAPS}) SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM t)), 6) + 0.0 AS value FROM t")
def impute_mean(spark, folder):
    events = events_with_gaps(spark, folder).select("event_id", "value")
    return rounded(S.impute(events, S.fit_means(events, ["value"])), ["value"])


@query("preprocess", f"""
WITH t AS (SELECT * FROM {_SQL_GAPS}), s AS (SELECT avg(value) AS m, min(value) AS lo, max(value) AS hi FROM t)
SELECT event_id, round((coalesce(value, m) - lo) / (hi - lo), 6) + 0.0 AS value FROM t, s""")
def preprocess(spark, folder):
    events = events_with_gaps(spark, folder).select("event_id", "value")
    return rounded(S.preprocess(events, ["value"]), ["value"])


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(*LINE_KEY, *FEATURES)


@query("minmax_unit", SQL_ANGLES + f" SELECT {SQL_KEYS}, {sql_rounded([f'x{i} / pi()' for i in range(4)], 'x')} FROM angles")
def minmax_unit(spark, folder):
    lines = _lines(spark, folder)
    return S.fit_minmax(lines, FEATURES).apply(lines).select(*LINE_KEY, *named(feature_columns(), "x"))


@query("minmax_pi", SQL_ANGLES + f" SELECT {SQL_KEYS}, {sql_rounded([f'x{i}' for i in range(4)], 'x')} FROM angles")
def minmax_pi(spark, folder):
    lines = _lines(spark, folder)
    return S.fit_angle_scale(lines, FEATURES).apply(lines).select(*LINE_KEY, *named(feature_columns(), "x"))


@query("row_minmax_pi", f"""
WITH t AS (SELECT *, least(l_quantity, l_extendedprice, l_discount, l_tax) AS lo,
                  greatest(l_quantity, l_extendedprice, l_discount, l_tax) AS hi FROM lineitem),
u AS (SELECT *, CASE WHEN hi - lo > 1e-12 THEN hi - lo ELSE 1.0 END AS w FROM t)
SELECT {SQL_KEYS}, {sql_rounded([f'({c} - lo) / w * pi()' for c in FEATURES], 'x')} FROM u""")
def row_minmax_pi(spark, folder):
    return _lines(spark, folder).select(*LINE_KEY, *named(row_angles(feature_columns()), "x"))


@query("standardize", SQL_SCALED + f" SELECT {SQL_KEYS}, is_test, {sql_rounded([f'x{i}' for i in range(4)], 'x', 4)} FROM scaled")
def standardize(spark, folder):
    lines = split_lines(spark, folder)
    return line_scaler(lines).apply(lines).select(*LINE_KEY, "is_test", *named(feature_columns(), "x", 4))


@query("split_hash", SQL_LINES + f" SELECT {SQL_KEYS}, is_test FROM rows_")
def split_hash(spark, folder):
    return X.hash_split(table(spark, folder, "lineitem"), LINE_KEY).select(*LINE_KEY, "is_test")


@query("split_exact", SQL_LINES + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY h, k) AS rn,
                  count(*) OVER (PARTITION BY l_linestatus) AS n FROM rows_)
SELECT {SQL_KEYS}, rn <= floor(n * 0.25 + 0.5) AS is_test FROM ranked""")
def split_exact(spark, folder):
    lines = table(spark, folder, "lineitem").select(*LINE_KEY, "l_linestatus")
    return X.exact_split(lines, LINE_KEY, "l_linestatus").select(*LINE_KEY, "is_test")


@query("split_unstratified", """
WITH h AS (SELECT vec_id, CAST('0x' || substr(md5(vec_id || '|7'), 1, 8) AS BIGINT) AS h FROM embeddings WHERE label IS NOT NULL),
r AS (SELECT vec_id, row_number() OVER (ORDER BY h, CAST(vec_id AS VARCHAR)) AS rn, count(*) OVER () AS n FROM h)
SELECT vec_id, rn <= floor(n * 0.3 + 0.5) AS is_test FROM r""")
def split_unstratified(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "label")
    return X.exact_split(vectors, ["vec_id"], "label", 0.3, 7).select("vec_id", "is_test")


@query("balanced_sample", SQL_LINES + f"""
SELECT {SQL_KEYS}, l_linestatus FROM (
  SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY h, k) AS rn FROM rows_) WHERE rn <= 150""")
def balanced_sample(spark, folder):
    lines = table(spark, folder, "lineitem").select(*LINE_KEY, "l_linestatus")
    return X.balanced_sample(lines, LINE_KEY, "l_linestatus", 300)


@query("balanced_sample_by_part", SQL_LINES + f"""
SELECT {SQL_KEYS} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY h, k) AS rn, dense_rank() OVER (ORDER BY l_partkey) - 1 AS place,
         (SELECT count(DISTINCT l_partkey) FROM lineitem) AS classes FROM rows_)
WHERE rn <= 25000 // classes + CASE WHEN place < 25000 % classes THEN 1 ELSE 0 END""")
def balanced_sample_by_part(spark, folder):
    """As many classes as there are parts."""
    lines = table(spark, folder, "lineitem").select(*LINE_KEY)
    return X.balanced_sample(lines, LINE_KEY, "l_partkey", 25_000)
