"""The corpus pipeline: language ID, exact dedup, near dedup, secret scan, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over the columns doc_id, text, lang, source, n_chars; what
it returns is written as Parquet and read again as the next one's docs. The last returns the pieces of the packing.

Nulls, empty texts, repeated rows and empty tables are handled as the operators of ``ledgerspark.llm`` say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common, exactdedup, jaccard, langid, packing, secrets

#: A text whose best language's mean probability is lower is rejected, as is one without a letter.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows that aren't held out; rows that get no language go."""
    return langid.accepted(docs, langid.fitted(docs), LEAST_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exactdedup.without_copies(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document with the smallest id stays."""
    return jaccard.one_of_each(docs).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays. n_chars follows the text."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: No stage but exact dedup can be put in SQL: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
