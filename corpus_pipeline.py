"""The corpus pipeline: five stages over `documents`, each written and read again as the next one's input.

Every stage takes tables with more columns than those of `documents`, whatever they
are called, and gives them back (the last one gives its own); an empty table gives an
empty one, and texts of any length are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark.llm import bpe, langid, lsh_forest, mixing, pii
from flowspark.llm.common import prepare, stored
from flowspark.llm.queries import vocabulary_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those go that have no letter, or a cosine below what held-out labelled rows reach.

    Null and empty texts go; rows without an id are judged but train nothing; repeated
    rows are judged one by one; without any labelled row all documents with a letter stay.
    """
    prepare(spark)
    held = langid.held_out(docs["doc_id"])
    prototypes = langid.train(docs.where(~held))
    return langid.in_language(docs, prototypes, cutoffs=langid.calibrate(docs.where(held), prototypes))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The one with the least id stays, a row without an id only if none of its group has
    one.  Different texts under one id are different documents.  Rows without words stay.
    """
    return lsh_forest.deduplicated(docs, percent=80, size=5)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by marks and n_chars corrected; null texts stay null."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say; none is lost.

    Rows without a source are a source of their own; texts without words weigh nothing.
    """
    return mixing.realised(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' counts and digests of every document of the mixture; a null text has no tokens."""
    return bpe.encode_decode(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: Language ID, the MinHash orders and the merges of a vocabulary aren't SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
