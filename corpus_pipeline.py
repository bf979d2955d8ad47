"""The training-data pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import bpe, decontaminate, language, neardup, secrets
from phasegrid.session import shared_folder

#: A document whose best language is less likely than this is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.5
#: Language ID, sketches and tokenization have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled ones that are not held out."""
    model = language.fit(docs, use=~language.held_out())
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def recognised(text):
        found, score = language.score_texts([t if isinstance(t, str) else None for t in text], *held.value)
        return pd.Series([f != language.UNKNOWN and s >= LEAST_LANGUAGE_SCORE for f, s in zip(found, score)])

    return docs.where(recognised("text"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, once if its row is repeated.

    Rows that share an id but not a text are no repeats of each other: all their texts stay. Rows without an id stay.
    """
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; a row without id is judged by its own text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.find_leaks(docs, items)
    named = docs.where("doc_id is not null").join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    unnamed = docs.where("doc_id is null")
    for held in decontaminate.index_parts(items):
        unnamed = unnamed.where(~leaking(held)("text"))
    return named.unionByName(unnamed)


def leaking(held):
    """Whether a text leaks an item of this part of the index."""

    @F.pandas_udf("boolean")
    def found(text):
        return text.map(lambda t: isinstance(t, str) and bool(decontaminate.leaks_of(t, held.value))).astype(bool)

    return found


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their text masked and n_chars counted anew where one was."""

    @F.pandas_udf("string")
    def masked(text):
        allowed = secrets.compiled()
        return text.map(lambda t: secrets.masked(t, secrets.written(secrets.spans_of(t, allowed))) if isinstance(t, str) else None)

    clean = docs.withColumn("clean", masked("text"))
    size = F.when(F.col("clean") == F.col("text"), F.col("n_chars")).otherwise(F.length("clean"))
    return clean.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).withColumn("text", F.col("clean")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of each document that is left."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("bpe_round_trip", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
