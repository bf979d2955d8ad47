"""Profiles, class balance, suitability, correlation and leak checks, schema-level mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.functions.values import nan_to_null
from phasegrid.operators import columns as C
from phasegrid.operators import profile as P
from phasegrid.operators.splitting import hash_split
from phasegrid.queries.registry import FEATURES, LINE_KEY, SQL_LINES, query, rounded, split_lines
from phasegrid.sources.tables import table


def _sql_numeric(source: str, column: str) -> str:
    stats = ", ".join(
        f"round_even({fn}({column}), 4) + 0.0 AS {name}"
        for fn, name in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))
    )
    return (
        f"SELECT '{column}' AS column_name, {stats}, "
        f"count(*) FILTER (WHERE {column} IS NULL) AS null_count, count(*) AS n_rows FROM {source}"
    )


@query("profile_numeric", " UNION ALL ".join([*[_sql_numeric("lineitem", c) for c in FEATURES], _sql_numeric("customer", "c_acctbal")]))
def profile_numeric(spark, folder):
    lines = P.numeric_profile(nan_to_null(table(spark, folder, "lineitem"), FEATURES), FEATURES)
    customers = P.numeric_profile(nan_to_null(table(spark, folder, "customer"), ["c_acctbal"]), ["c_acctbal"])
    return rounded(lines.unionByName(customers), ["mean", "std", "min", "max"], 4)


# values missing for one event type
_SQL_GAPS = "(SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"


def events_with_gaps(spark, folder):
    known = F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    return table(spark, folder, "events").select("event_id", "event_type", known)


@query("profile_with_gaps", _sql_numeric(_SQL_GAPS, "value"))
def profile_with_gaps(spark, folder):
    return rounded(P.numeric_profile(events_with_gaps(spark, folder), ["value"]), ["mean", "std", "min", "max"], 4)


_CATEGORICAL = {"orders": ("o_orderstatus", "o_orderpriority"), "part": ("p_name", "p_brand", "p_type")}
_SQL_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM {t} GROUP BY {c}" for t, cs in _CATEGORICAL.items() for c in cs
)


def _categorical(spark, folder, operator):
    parts = [operator(table(spark, folder, t), cs) for t, cs in _CATEGORICAL.items()]
    return parts[0].unionByName(parts[1])


@query("profile_categorical", f"""
SELECT column_name, CAST(value_rank AS INTEGER) AS value_rank, value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS value_rank
  FROM ({_SQL_VALUES}) v WHERE value IS NOT NULL) r
WHERE value_rank <= 5""")
def profile_categorical(spark, folder):
    return _categorical(spark, folder, P.categorical_profile)


@query("categorical_summary", f"""
SELECT column_name, count(value) AS n_distinct, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS null_count
FROM ({_SQL_VALUES}) v GROUP BY column_name""")
def categorical_summary(spark, folder):
    return _categorical(spark, folder, P.categorical_summary)


@query("column_report", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS type_name, {n} AS is_numeric, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS n_rows FROM orders"
    for c, t, n in (
        ("o_orderkey", "bigint", "true"), ("o_custkey", "bigint", "true"), ("o_orderstatus", "string", "false"),
        ("o_totalprice", "double", "true"), ("o_orderdate", "timestamp_ntz", "false"), ("o_orderpriority", "string", "false"))
))
def column_report(spark, folder):
    return P.column_report(table(spark, folder, "orders"))


@query("class_balance", """
SELECT l_returnflag AS value, count(*) AS n, (SELECT count(*) FROM lineitem) AS n_rows,
       (SELECT count(*) FROM lineitem WHERE l_returnflag IS NULL) AS n_missing_label
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def class_balance(spark, folder):
    return P.class_balance(table(spark, folder, "lineitem"), "l_returnflag")


@query("class_balance_missing", """
WITH j AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT CAST(quality AS VARCHAR) AS value, count(*) AS n, (SELECT count(*) FROM j) AS n_rows,
       (SELECT count(*) FROM j WHERE quality IS NULL) AS n_missing_label
FROM j WHERE quality IS NOT NULL GROUP BY quality""")
def class_balance_missing(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return P.class_balance(joined, "quality")


@query("dataset_summary", SQL_LINES + """
SELECT 4 AS feature_count, 'l_quantity,l_extendedprice,l_discount,l_tax' AS feature_columns, 'label' AS label_column,
       count(*) FILTER (WHERE NOT is_test) AS n_train, count(*) FILTER (WHERE is_test) AS n_test,
       avg(label) FILTER (WHERE NOT is_test) AS train_positive_rate,
       avg(label) FILTER (WHERE is_test) AS test_positive_rate
FROM rows_""")
def dataset_summary(spark, folder):
    summary = P.dataset_summary(split_lines(spark, folder), FEATURES, "label", "is_test")
    return summary.withColumn("feature_columns", F.array_join("feature_columns", ","))


_SQL_SUITABLE = """
WITH t AS (
  SELECT d.n_chars, CAST(len(string_split(d.text, ' ')) AS BIGINT) AS n_words, l.toxic, l.quality
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
a AS (
  SELECT count(*) AS n,
         coalesce(sum((n_chars IS NULL)::INT + (n_words IS NULL)::INT + (toxic IS NULL)::INT + (quality IS NULL)::INT), 0) AS nulls,
         count(*) FILTER (WHERE quality IS NULL OR quality NOT IN (0, 1)) AS odd,
         avg(quality) FILTER (WHERE quality IN (0, 1)) AS rate
  FROM t)
SELECT 'row_count' AS rule, CAST(n AS DOUBLE) AS observed,
       CASE WHEN n < 60 THEN 'too_few' WHEN n < 80 THEN 'marginal' WHEN n < 150 THEN 'good' WHEN n <= 500 THEN 'very_good'
            ELSE 'slow_sample_advised' END AS status FROM a
UNION ALL SELECT 'feature_count', 3.0, 'fast' FROM a
UNION ALL SELECT 'no_missing_values', CAST(nulls AS DOUBLE), CASE WHEN nulls = 0 THEN 'ok' ELSE 'violated' END FROM a
UNION ALL SELECT 'label_is_0_or_1', CAST(odd AS DOUBLE), CASE WHEN odd = 0 THEN 'ok' ELSE 'violated' END FROM a
UNION ALL SELECT 'class_balance', rate, CASE WHEN rate BETWEEN 0.4 AND 0.6 THEN 'ok' ELSE 'violated' END FROM a"""


@query("suitability_rules", _SQL_SUITABLE)
def suitability_rules(spark, folder):
    words = F.size(F.split("text", " ")).cast("bigint").alias("n_words")
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", words)
    joined = table(spark, folder, "labels").join(docs, "doc_id")
    return P.suitability(joined, ["n_chars", "n_words", "toxic"], "quality")


_PAIRS = (("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice"))


@query("correlated_pairs", "SELECT feature_a, feature_b, round(r, 6) + 0.0 AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM part" for a, b in _PAIRS
) + ") WHERE abs(r) >= 0.4")
def correlated_pairs(spark, folder):
    return rounded(P.correlated_pairs(table(spark, folder, "part"), ["p_partkey", "p_size", "p_retailprice"], 0.4), ["r"])


@query("feature_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem"
    for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]
))
def feature_correlations(spark, folder):
    return rounded(P.correlated_pairs(table(spark, folder, "lineitem"), FEATURES, 0.0), ["r"])


@query("leak_check", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(abs((SELECT corr({c}, (l_discount >= 0.05)::INT) FROM lineitem)), 6) + 0.0 AS abs_r,
       count(*) AS n_values, count(*) FILTER (WHERE lo = hi) AS n_pure_values,
       abs((SELECT corr({c}, (l_discount >= 0.05)::INT) FROM lineitem)) >= 0.999
         OR (count(*) FILTER (WHERE lo = hi) = count(*) AND count(*) < sum(n)) AS is_leak
FROM (SELECT {c} + 0.0 AS v, count(*) AS n, min((l_discount >= 0.05)::INT) AS lo, max((l_discount >= 0.05)::INT) AS hi
      FROM lineitem GROUP BY 1)""" for c in ("l_quantity", "l_discount", "l_tax")))
def leak_check(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("label", (F.col("l_discount") >= 0.05).cast("int"))
    return rounded(P.leak_check(lines, ["l_quantity", "l_discount", "l_tax"], "label"), ["abs_r"])


@query("inferred_label_balance", """
SELECT 'label' AS label_column, 'vec_id,embedding' AS feature_columns, CAST(label AS VARCHAR) AS value, count(*) AS n
FROM embeddings WHERE label IS NOT NULL GROUP BY label""")
def inferred_label_balance(spark, folder):
    vectors = table(spark, folder, "embeddings")
    label, features = C.infer_label(vectors.columns)
    balance = P.class_balance(vectors, label)
    return balance.select(F.lit(label).alias("label_column"), F.lit(",".join(features)).alias("feature_columns"), "value", "n")


@query("default_mapping_balance", """
SELECT 'o_totalprice' AS label_column, 'o_orderkey,o_custkey' AS feature_columns, count(o_totalprice) AS n_labelled,
       round(avg(o_totalprice), 6) + 0.0 AS mean_label FROM orders""")
def default_mapping_balance(spark, folder):
    orders = table(spark, folder, "orders")
    label, features = C.default_mapping(orders, numeric_only=True)
    return rounded(orders.agg(
        F.lit(label).alias("label_column"), F.lit(",".join(features)).alias("feature_columns"),
        F.count(label).alias("n_labelled"), F.avg(label).alias("mean_label"),
    ), ["mean_label"])


@query("preview_rows", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality, coalesce(CAST(toxic AS VARCHAR), '') AS toxic
FROM (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY d.doc_id LIMIT 20)""")
def preview_rows(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return C.preview(joined, ["doc_id"], 20, blank=True)


@query("project_features", "SELECT l_quantity + 0.0 AS l_quantity, l_tax + 0.0 AS l_tax, l_linestatus FROM lineitem")
def project_features(spark, folder):
    lines = table(spark, folder, "lineitem")
    kept = C.existing_columns(lines, ["l_quantity", "no_such_column", "l_tax", "l_linestatus"])
    return lines.select(*kept).withColumns({c: F.col(c) + 0.0 for c in ("l_quantity", "l_tax")})


@query("cast_features", """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN 'x' || value ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value
FROM events""")
def cast_features(spark, folder):
    # 'n/a' is a missing token, 'x1.5' is no number
    raw = (
        F.when(F.col("event_type") == "error", "n/a")
        .when(F.col("event_type") == "click", F.concat(F.lit("x"), F.col("value").cast("string")))
        .otherwise(F.col("value").cast("string"))
    )
    events = table(spark, folder, "events").select("event_id", raw.alias("value"))
    return C.cast_features(events, ["value"], lenient=True)


@query("split_positive_rates", SQL_LINES + """
SELECT is_test, count(*) AS n, avg(label) AS positive_rate FROM rows_ GROUP BY is_test""")
def split_positive_rates(spark, folder):
    lines = hash_split(
        table(spark, folder, "lineitem").withColumn("label", (F.col("l_linestatus") == "O").cast("int")), LINE_KEY
    )
    return lines.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("positive_rate"))


_MIXED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("value_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, is_key AS is_approximate, CASE WHEN is_key THEN NULL ELSE n_distinct::DOUBLE END AS n_distinct, null_count, value_rank, value, n
FROM (SELECT count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) > greatest(1000, 0.5 * count({c})) AS is_key, count(*) - count({c}) AS null_count FROM orders) s
LEFT JOIN (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS value_rank
           FROM orders WHERE {c} IS NOT NULL GROUP BY 1 QUALIFY value_rank <= 5) t ON NOT is_key
WHERE NOT is_key""" for c in _MIXED))
def value_profile(spark, folder):
    """Exact columns of a table that also has a key; those that are read from sketches are left out of the comparison."""
    found = P.value_profile(table(spark, folder, "orders"), _MIXED)
    return found.where("NOT is_approximate").select(
        "column_name", "is_approximate", F.col("n_distinct").cast("double").alias("n_distinct"), "null_count", "value_rank", "value", "n"
    )


_WIDE = [f"w{k}" for k in range(60)]


@query("wide_correlations", """
WITH w AS (SELECT """ + ", ".join(f"sin(l_quantity * {k + 1} + l_discount * {k % 7}) + l_tax * {k % 5} AS w{k}" for k in range(60)) + """ FROM lineitem),
pairs AS (""" + "SELECT unnest([" + ", ".join(f"{{'a': 'w{a}', 'b': 'w{b}', 'r': corr(w{a}, w{b})}}" for a in range(60) for b in range(a + 1, 60) if (a + b) % 12 == 0) + """]) AS p FROM w)
SELECT p.a AS feature_a, p.b AS feature_b, round(p.r, 6) + 0.0 AS r FROM pairs WHERE abs(p.r) >= 0.2""")
def wide_correlations(spark, folder):
    """All pairs of 60 columns from one scan; every twelfth pair is compared."""
    wide = table(spark, folder, "lineitem").select(*[
        (F.sin(F.col("l_quantity") * (k + 1) + F.col("l_discount") * (k % 7)) + F.col("l_tax") * (k % 5)).alias(c) for k, c in enumerate(_WIDE)
    ])
    place = lambda c: F.substring(c, 2, 3).cast("int")
    return rounded(P.correlated_pairs(wide, _WIDE, 0.2).where((place("feature_a") + place("feature_b")) % 12 == 0), ["r"])
