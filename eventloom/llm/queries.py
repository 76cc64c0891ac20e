"""One query for each corpus operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, langid, leaks, neighbours, pii, pll, quality, repeats, shared, tokenfile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.fresh(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.summary(spark, path)


def op8_suffix_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pll.scores(table(spark, sf_dir, "documents"))


def op5_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_fm_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), n=13, digest_only=True)


def op10_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_prediction(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe_codec, op2_token_orc, op3_site_quality, op4_pseudo_likelihood, op5_jaccard_classes, op6_context_pii, op7_block_neighbours, op8_suffix_leaks, op9_fm_repeats, op10_hd_language)}
ORACLE_SQL: dict[str, str] = {}
