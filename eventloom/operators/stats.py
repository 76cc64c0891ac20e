"""Mergeable statistics of a field's terms, as aggregates.

The count-min sketch and the Bloom filter are kept as rows (row, bucket, count) and (word, bits), so that merging is a
grouped sum or bit-or and a lookup is a join; HyperLogLog sketches are Spark's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .postings import text_of

#: Parameters and seeds of the sketches.
CMS_EPS, CMS_CONFIDENCE, CMS_SEED = 0.001, 0.99, 123456789
HLL_BITS = 16
BLOOM_HASHES, BLOOM_SEED = 16, 987654321
MINHASH_HASHES, MINHASH_BANDS = 16, 64
#: Slots in a row of aggregates: as many as Spark still compiles as a whole (100 columns).
_BLOCK = 64

DEPTH = math.ceil(math.log(1 / (1 - CMS_CONFIDENCE)))
WIDTH = math.ceil(math.e / CMS_EPS)


def term_count(terms: DataFrame, by: list[str] | None = None) -> DataFrame:
    return terms.groupBy(*(by or [])).agg(F.count("term").alias("term_count"))


def term_frequency(terms: DataFrame, by: list[str] | None = None) -> DataFrame:
    return terms.where(F.col("term").isNotNull()).groupBy(*(by or []), "term").agg(F.count(F.lit(1)).alias("frequency"))


def cardinality_exact(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count_distinct("term").alias("cardinality"))


def hll(terms: DataFrame, by: list[str] | None = None) -> DataFrame:
    return terms.groupBy(*(by or [])).agg(F.hll_sketch_agg("term", HLL_BITS).alias("sketch"))


def merge_hll(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    return sketches.groupBy(*(by or [])).agg(F.hll_union_agg("sketch").alias("sketch"))


def hll_cardinality(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("cardinality", F.hll_sketch_estimate("sketch"))


def _bucket(term: Column, row: Column | int, seed: int, width: int) -> Column:
    number = F.lit(row) if isinstance(row, int) else row
    return F.pmod(F.xxhash64(F.lit(seed), number, term), F.lit(width))


def count_min(terms: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(row, bucket, count) from exact frequencies, so each distinct term is hashed once."""
    counts = term_frequency(terms, by)
    rows = F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1)))
    hashed = counts.select(*(by or []), "term", "frequency", rows.alias("row"))
    return merge_count_min(hashed.select(*(by or []), "row", _bucket(F.col("term"), F.col("row"), CMS_SEED, WIDTH).alias("bucket"), F.col("frequency").alias("count")), by)


def merge_count_min(sketch: DataFrame, by: list[str] | None = None) -> DataFrame:
    return sketch.groupBy(*(by or []), "row", "bucket").agg(F.sum("count").alias("count"))


def estimate_frequency(sketch: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, estimate``: the least of its buckets; never below the true frequency."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1)))
    asked = terms.select("term").distinct().select("term", rows.alias("row")).withColumn("bucket", _bucket(F.col("term"), F.col("row"), CMS_SEED, WIDTH))
    return asked.join(sketch, ["row", "bucket"], "left").groupBy("term").agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


def bloom_bits(n: int, rate: float = 0.01) -> int:
    """Bits for ``n`` terms at a false-positive rate, a multiple of 64 (the published 64 bits saturate at once)."""
    return max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)


def _bits(bits: int) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(BLOOM_HASHES - 1)), lambda i: F.pmod(F.xxhash64(F.lit(BLOOM_SEED), i, F.col("term")), F.lit(bits))))


def bloom(terms: DataFrame, bits: int) -> DataFrame:
    """(word, bits): the set bits of a filter of ``bits`` bits."""
    hashed = terms.select("term").where("term is not null").distinct().select(_bits(bits).alias("at"))
    words = hashed.select((F.col("at") / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bits"))
    return merge_bloom(words)


def merge_bloom(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def maybe_member(words: DataFrame, terms: DataFrame, bits: int) -> DataFrame:
    """``term, member``: false only for terms that are certainly absent."""
    asked = terms.select("term").distinct().select("term", _bits(bits).alias("at")).withColumn("word", (F.col("at") / 64).cast("long"))
    joined = asked.join(words, "word", "left")
    is_set = F.coalesce(F.call_function("shiftright", F.col("bits"), (F.col("at") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.groupBy("term").agg(F.bool_and(is_set).alias("member"))


def minhash(terms: DataFrame, by: list[str] | None = None, slots: int = MINHASH_HASHES * MINHASH_BANDS) -> DataFrame:
    """``slot, least``: a signature; the share of equal slots estimates the Jaccard similarity. The slots of a
    block are aggregates of one row, so that a term is a row for each block."""
    distinct = terms.where("term is not null").select(*(by or []), "term").distinct()
    blocks = distinct.select(*(by or []), "term", F.explode(F.sequence(F.lit(0), F.lit((slots - 1) // _BLOCK))).alias("__block"))
    first = F.col("__block") * _BLOCK
    least = blocks.groupBy(*(by or []), "__block").agg(*[F.min(F.xxhash64(first + i, "term")).alias(f"__{i}") for i in range(1, _BLOCK + 1)])
    rows = least.select(*(by or []), first.alias("__first"), F.posexplode(F.array(*[f"__{i}" for i in range(1, _BLOCK + 1)])).alias("__at", "least"))
    return rows.select(*(by or []), (F.col("__first") + F.col("__at")).alias("slot"), "least").where(F.col("slot") < slots)


def merge_minhash(signatures: DataFrame, by: list[str] | None = None) -> DataFrame:
    return signatures.groupBy(*(by or []), "slot").agg(F.min("least").alias("least"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("least", "other"), "slot")
    return both.agg(F.avg((F.col("least") == F.col("other")).cast("double")).alias("similarity"))


class Frequencies:
    """Statistics for cost estimates: frequencies of the terms of a query, read on demand from ``field, term, frequency``."""

    def __init__(self, table: DataFrame, events: int):
        self.table, self.events, self.known = table, events, {}

    def load(self, pairs: list[tuple[str, str | None]]) -> None:
        """Fetches what a query needs in one small job; None asks for the sum over a field."""
        terms = [(f, t) for f, t in pairs if t is not None]
        if terms:
            wanted = self.table.where(F.col("field").isin(sorted({f for f, _ in terms})) & F.col("term").isin(sorted({t for _, t in terms})))
            self.known |= {(r["field"], r["term"]): r["frequency"] for r in wanted.collect()}  # a row for each term asked
        fields = sorted({f for f, t in pairs if t is None})
        if fields:
            self.known |= {(r["field"], None): r["n"] for r in self.table.where(F.col("field").isin(fields)).groupBy("field").agg(F.sum("frequency").alias("n")).collect()}

    def __call__(self, field, term) -> int:
        return self.events if field is None else int(self.known.get((str(field), None if term is None else text_of(term)), 0))
