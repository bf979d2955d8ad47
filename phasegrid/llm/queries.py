"""Registered queries of the operators, each over its whole table, and DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import bpe, covertree, decontaminate, language, licenses, neardup, negatives, phrases, pieces, repair, secrets, tokens, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_repeated_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, folder, "documents"))


@query
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.listed_sites(pages)).select("page_id", "host", "path", "rule", "verdict")


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query
def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs, use=~language.held_out())
    return (
        language.predict(docs, model)
        .withColumn("held_out", language.held_out())
        .select("doc_id", "held_out", "lang_pred", "score")
    )


@query
def op8_cover_tree_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_pairs(table(spark, folder, "embeddings"))


@query
def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(table(spark, folder, "conversations")), there="there")


@query
def op12_sentencepiece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = negatives.taking_part(table(spark, folder, "embeddings"))
    mislabelled = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", mislabelled))


_PARSED = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
named AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') AS address,
         list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills']) AS on_listed_site
  FROM parsed),
listed AS (SELECT DISTINCT address FROM named WHERE on_listed_site AND address <> ''),
rules AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(site, start_, said)),
fitting AS (
  SELECT page_id, arg_max(site || start_, length(site || start_)) AS rule, arg_max(said, length(site || start_)) AS said
  FROM named, rules
  WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start_)
  GROUP BY page_id)
"""
ORACLE["op3_url_filter"] = _PARSED + """
SELECT n.page_id, n.host, n.path, f.rule,
       coalesce(f.said, CASE WHEN n.address IN (SELECT address FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fitting f ON n.page_id = f.page_id
"""

# crc32 by its definition, bit by bit; then the damage, the faults in order, and the cheapest edits row by row: of all
# prefixes that end in one role state (0 start, 1 after s, 2 after u, 3 after a) the least (cost, audit) is kept
ORACLE["op11_conversation_repair"] = r"""
WITH RECURSIVE cells AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
           4294967295::BIGINT) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM cells WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role)::VARCHAR || ':' || role || text)) AS pos,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial,
         CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         substr(role, 1, 1) || coalesce(lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos), '?') AS pair,
         lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) IS NOT NULL AS has_next
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (has_next AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
following AS (SELECT * FROM (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS f(state, role, next_state)),
inserts AS (
  SELECT state AS from_state, '' AS letters, 0 AS price, state AS to_state FROM following
  UNION ALL SELECT state, 'I', 5, next_state FROM following
  UNION ALL SELECT a.state, 'II', 10, b.next_state FROM following a JOIN following b ON a.next_state = b.state),
search AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM judged
  UNION ALL
  SELECT conv_id, pos, state, min(best) FROM (
    SELECT s.conv_id, j.pos, e.state, {'cost': (s.best.cost + i.price + e.price)::BIGINT, 'audit': s.best.audit || i.letters || e.letter} AS best
    FROM search s
    JOIN inserts i ON i.from_state = s.state
    JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.pos = s.pos + 1
    JOIN following f ON f.state = i.to_state,
    LATERAL (SELECT unnest([
      {'letter': 'D', 'price': 2, 'state': i.to_state, 'fits': true},
      {'letter': 'K', 'price': CASE WHEN j.fault = 'truncated' THEN 5 ELSE 0 END,
       'state': CASE WHEN j.initial = 's' THEN 1 ELSE f.next_state END,
       'fits': j.fault NOT IN ('blank', 'duplicate') AND (j.initial = f.role OR (j.initial = 's' AND i.to_state = 0))},
      {'letter': 'R', 'price': CASE WHEN j.fault = 'truncated' THEN 6 ELSE 1 END, 'state': f.next_state,
       'fits': j.fault NOT IN ('blank', 'duplicate')}], recursive := true)) AS e
    WHERE e.fits)
  GROUP BY conv_id, pos, state),
solved AS (
  SELECT s.conv_id, min({'cost': (s.best.cost + i.price)::BIGINT, 'audit': s.best.audit || i.letters}) AS best
  FROM search s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.pos
  JOIN inserts i ON i.from_state = s.state AND i.to_state IN (0, 3)
  GROUP BY s.conv_id),
edits AS (
  SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS spot
  FROM solved WHERE best.audit <> ''),
placed_edits AS (
  SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY spot) AS pos FROM edits),
kept_edits AS (
  SELECT e.conv_id, e.spot, e.letter, j.role, j.text, j.initial,
         row_number() OVER (PARTITION BY e.conv_id ORDER BY e.spot) AS place
  FROM placed_edits e LEFT JOIN judged j ON e.letter <> 'I' AND j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.pos = e.pos
  WHERE e.letter <> 'D'),
turned AS (
  SELECT *, (place + CASE WHEN first(letter = 'K' AND initial = 's') OVER (PARTITION BY conv_id ORDER BY spot) THEN 1 ELSE 0 END) % 2 AS odd
  FROM kept_edits),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY spot) AS all_text
  FROM turned GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(s.best.cost, 0) AS cost,
       coalesce(s.best.audit, '') AS audit, sha256(coalesce(r.all_text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLE["op13_hard_negatives"] = """
WITH rows_ AS (
  SELECT row_number() OVER () AS number, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * x::DOUBLE))) = 0),
scored AS (
  SELECT a.number, a.id AS anchor_id, b.number AS other, b.id, a.label = b.label AS same_label,
         coalesce(list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: a.vector[i] * b.vector[i])), 0)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.id % 50 = 0 AND a.number <> b.number AND len(a.vector) = len(b.vector)),
positives AS (
  SELECT number, anchor_id, other, id AS positive_id, score AS positive_score FROM scored WHERE same_label
  QUALIFY row_number() OVER (PARTITION BY number ORDER BY score DESC, id, other) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.number, p.other ORDER BY n.score DESC, n.id, n.other)::INTEGER AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.number = p.number AND NOT n.same_label
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
