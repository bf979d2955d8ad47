import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with the columns of the table and others that clash with names the operators use."""

    def make(rows, parts=3):
        rows = [(r + (None,) * 5)[:5] for r in (tuple(x) for x in rows)]
        frame = spark.createDataFrame(rows, DOCS).repartition(parts)
        return frame.selectExpr("*", "1 as score", "'x' as spans", "2 as component_id", "3 as rep", "4 as n_words", "5 as block", "6 as kept")

    return make


#: Cases that every text operator has to stand: null, empty, white space, a long text, ties, repeated rows, a null id.
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word " * 30000), (5, "same text of a few plain words here"),
    (6, "same text of a few plain words here"), (6, "same text of a few plain words here"), (None, "no id at all"),
    (7, "Ünï\u0301cödé 你好 \U0001f600 x\u00a0y \u2028 İstanbul ſecret K ²½"), (8, "a"), (9, "1234 !!! ???"),
]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD_TEXTS)


@pytest.fixture(scope="session")
def small_docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
