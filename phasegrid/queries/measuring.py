"""Measured bitstring counts, taken from the events table: one sample per user, four bits per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.operators import measurement as M
from phasegrid.queries.registry import query
from phasegrid.sources.tables import table

_SQL_COUNTS = """
WITH raw AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 16 AS bits, 1 + event_id % 3 AS cnt FROM events),
q AS (SELECT user_id, bits, (bits & 1) * 8 + ((bits >> 1) & 1) * 4 + ((bits >> 2) & 1) * 2 + ((bits >> 3) & 1) AS reversed, cnt FROM raw)"""


def counts(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint") % 16
    return table(spark, folder, "events").select(
        "user_id", F.lpad(F.conv(k, 10, 2), 4, "0").alias("bitstring"), (1 + F.col("event_id") % 3).alias("cnt")
    )


@query("z_expectation", _SQL_COUNTS + """
SELECT user_id, CAST(qubit AS INTEGER) AS qubit,
       sum(CASE WHEN (bits >> qubit) & 1 = 0 THEN cnt ELSE -cnt END) / sum(cnt)::DOUBLE AS expectation
FROM q, (SELECT unnest(range(4)) AS qubit) GROUP BY user_id, qubit""")
def z_expectation(spark, folder):
    return M.z_expectation(counts(spark, folder), "user_id", "bitstring", "cnt", 4)


@query("counts_to_probs", _SQL_COUNTS + """,
total AS (SELECT user_id, sum(cnt) AS n FROM q GROUP BY user_id),
cell AS (SELECT user_id, reversed, sum(cnt) AS n FROM q GROUP BY user_id, reversed)
SELECT t.user_id, CAST(g.state AS INTEGER) AS state, coalesce(c.n, 0) / t.n::DOUBLE AS probability
FROM total t CROSS JOIN (SELECT unnest(range(8)) AS state) g LEFT JOIN cell c ON c.user_id = t.user_id AND c.reversed = g.state""")
def counts_to_probs(spark, folder):
    # three qubits for four-bit strings: the upper half counts in the total only
    dense = M.distribution(counts(spark, folder), "user_id", "bitstring", "cnt", 3)
    return dense.select("user_id", F.posexplode("probabilities").alias("state", "probability"))


@query("parity_readout", _SQL_COUNTS + """
SELECT user_id, 1 - coalesce(sum(cnt) FILTER (WHERE bit_count(bits) % 2 = 1), 0) / sum(cnt)::DOUBLE AS p_even,
       coalesce(sum(cnt) FILTER (WHERE bit_count(bits) % 2 = 1), 0) / sum(cnt)::DOUBLE AS p_odd
FROM q GROUP BY user_id""")
def parity_readout(spark, folder):
    return M.parity_readout(counts(spark, folder), "user_id", "bitstring", "cnt")
