"""Every registered query against its DuckDB statement on the smallest tables."""

import re

import pytest
from check_oracles import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


def test_each_query_has_an_oracle():
    assert {q for q in set(QUERIES) - set(ORACLE) if not re.match(r"op\d+_|pipeline$", q)} == set()
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, data, duck, name):
    assert compare(QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE[name]).df()).startswith("ok")


def test_entry(spark, data):
    rows = entry(spark).collect()
    assert len(rows) == 2 and all(r["n_samples"] > 0 for r in rows)
