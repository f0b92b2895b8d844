"""A cleaning pipeline over documents: language, exact copies, near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm import exact_dedup, language_id, ngram_join, packing, pii
from corpuskit.llm._text import without
from corpuskit.plans.scratch import Scratch

#: Near copies share 80 % of their five-word shingles.
WORDS, SHARE = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.

    Null and empty texts and texts without a letter are in none, so they go;
    repeated rows of a kept id stay repeated, rows with a null id always stay.
    """
    found = language_id.identify(language_id.documents_as_rows(docs), language_id.fit(docs, "text", "lang", "doc_id"))
    return without(docs, found.where("not kept").select(F.col("id").alias("doc_id")), "doc_id")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with most characters, then the smallest id.

    Null counts as the empty text; rows with a null id stay.
    """
    found = exact_dedup.exact_dedup(*exact_dedup.history_and_incoming(docs))
    return without(docs, found.where("not kept").select("doc_id"), "doc_id")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near copies.

    Null and empty texts are near to nothing, so they stay, as do rows with a null id.
    """
    found = ngram_join.jaccard_components(docs, WORDS, SHARE, 100)
    return without(docs, found.where("doc_id <> component_id").select("doc_id"), "doc_id")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by the names of its kinds.

    All rows stay; null texts stay null, and so does their number of characters.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in windows of 1024.

    Null and empty texts are their end token alone; an empty table has no places.
    """
    # Heaps that have grown in the stages before leave little memory for Python.
    return packing.pack(docs, slice_bytes=1_500_000, remembered=300_000)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near), ("pii", personal_data), ("packing", windows)]
#: Language models, tokenizers and components of near copies can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
