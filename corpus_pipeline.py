"""From raw documents to token ids: five corpus operators in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bpe, jaccard, langid, leaks, pii, shared


#: Rows that cross to Python at a time; a batch of whole texts is held several times over, in and outside the JVM.
BATCH_ROWS = 1000


def bounded(stage):
    """A stage whose texts cross to Python in batches of BATCH_ROWS; the session keeps the setting, as stages are lazy."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or unlike every language of the corpus, go."""
    return langid.accepted(docs)


@bounded
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


@bounded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim window of eight words of a benchmark item go."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=8, least_items=1)


@bounded
def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


@bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of the text."""
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", "ids")


STAGES = [("language", language), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("privacy", privacy), ("tokens", tokens)]

#: Stages two to five have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
