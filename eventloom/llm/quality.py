"""Quality and toxicity by hierarchical empirical Bayes.

1. A document classifier (logistic regression on hashed words, word beginnings and shape features, fitted in numpy on at
   most ``SAMPLE`` labelled documents, drawn by a hash of the id) gives each document's evidence as log odds.
2. Grouped aggregates give, for every host and every path below it, the documents and their expected positives (known
   labels count as such). The between-site variance beyond chance sets the strength of the prior (method of moments), so
   sparse sites shrink towards their host, and hosts towards the corpus.
3. A document's posterior odds are its own odds times the odds of its path, without the document itself, over those of
   the corpus.

All documents take part in 1 (scoring) and 2. The hosts and paths are aggregated map-side, so a hot host is one row a
task; site tables are broadcast only after being counted.

Edge cases: null or empty texts give no evidence (the site's prior alone decides); a null host or path is a site of its
own; documents of no label are scored like all; labels of unknown documents, and null labels, are ignored; several
labels of one document count by their mean; without labels of both values for a head all its evidence is 0; an empty
table gives no rows; repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, textblock
from .jaccard import small

SAMPLE = 12_000
BITS = 18
EPOCHS = 10
LEAST_Z = 4.0
MOST_STRENGTH = 1e6
HEADS = ("quality", "toxic")
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_SHAPES = {"upper": range(65, 91), "digit": range(48, 58), "mark": b"!?", "bar": b"|\\/<>{}[]", "line": b"\n"}
_LUT = {name: np.isin(np.arange(256), list(chars)) for name, chars in _SHAPES.items()}


def features(block: textblock.Block, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, distinct and sorted; ``raw``: the bytes before lower-casing."""
    mask = np.uint64((1 << BITS) - 1)
    begins = textblock.range_hashes(block.data, block.starts, np.minimum(block.starts + 4, block.ends))
    begins5 = textblock.range_hashes(block.data, block.starts, np.minimum(block.starts + 5, block.ends))
    doc = block.docs_of_words()
    codes = [block.hashes() & mask, textblock.mix(begins ^ np.uint64(4)) & mask, textblock.mix(begins5 ^ np.uint64(5)) & mask]
    docs = [doc, doc, doc]
    edges = np.append(block.starts, len(block.data))[np.minimum(block.bounds, len(block.starts))]
    size = np.maximum(np.diff(edges), 1)
    for k, table in enumerate(_LUT.values()):
        share = np.diff(np.concatenate([[0], np.cumsum(table[raw])])[np.minimum(edges, len(raw))]) / size
        level = np.where(share > 0, np.ceil(np.log2(np.maximum(share, 2.0**-12))) + 13, 0).astype(np.uint64)
        codes.append(textblock.mix(level + np.uint64(1000 * (k + 1))) & mask)
        docs.append(np.arange(block.n_docs))
    # how many of the words are distinct, in sixteenths, by the order of length
    words = np.unique((doc.astype(np.int64) << BITS) | codes[0].astype(np.int64)) >> BITS
    share = np.bincount(words, minlength=block.n_docs) / np.maximum(np.diff(block.bounds), 1)
    level = (np.ceil(share * 16) + 32 * np.ceil(np.log2(np.diff(block.bounds) + 1) / 2)).astype(np.uint64)
    codes.append(textblock.mix(level + np.uint64(50_000)) & mask)
    docs.append(np.arange(block.n_docs))
    pairs = np.unique((np.concatenate(docs).astype(np.int64) << BITS) | np.concatenate(codes).astype(np.int64))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _featured(texts: pa.Array) -> Iterator[tuple[textblock.Block, np.ndarray, np.ndarray]]:
    data, offsets = textblock.as_bytes(texts)
    for block in textblock.blocks(texts, textblock.word_table(_SPACES), lower=True):
        yield block, *features(block, data[offsets[block.first] : offsets[block.first + block.n_docs]])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, doc, feature in _featured(batch.column("text")):
            bounds = np.searchsorted(doc, np.arange(block.n_docs + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(feature, pa.int32()))
            part = batch.slice(block.first, block.n_docs)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, *[part.column(h) for h in HEADS]], names=["doc_id", "features", *HEADS])


def fit(features_: list[np.ndarray], target: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, by adaptive gradient steps over shuffled batches.

    Only features whose share of positives differs from the rest by LEAST_Z standard errors get a weight, so that one
    telling word counts in a long document as much as in a short one.
    """
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    known = np.flatnonzero(~np.isnan(target))
    rate = target[known].mean() if len(known) else 0.0
    if not 0 < rate < 1:
        return weights, bias
    bias = math.log(rate / (1 - rate))
    flat = np.concatenate([features_[i] for i in known])
    sizes = [len(features_[i]) for i in known]
    seen = np.bincount(flat, minlength=1 << BITS)
    positive = np.bincount(flat, np.repeat(target[known], sizes), 1 << BITS)
    z = (positive - rate * seen) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    chosen = (np.abs(z) >= LEAST_Z) & (seen >= 5)
    kept = {i: f[chosen[f]] for i in known for f in [features_[i]]}
    squares, random = np.full(1 << BITS, 1e-2, np.float32), np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        order = random.permutation(known)
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            flat = np.concatenate([kept[i] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(kept[i]) for i in rows])
            logit = np.bincount(owner, weights[flat], len(rows)) + bias
            slope = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target[rows]
            touched, which = np.unique(flat, return_inverse=True)
            gradient = (np.bincount(which, slope[owner], len(touched)) + 1e-3 * weights[touched]).astype(np.float32)
            squares[touched] += gradient**2
            weights[touched] -= 0.2 / (1 + epoch / 4) * gradient / np.sqrt(squares[touched])
    return weights, bias


def train(docs: DataFrame, labels: DataFrame) -> dict[str, tuple[np.ndarray, float]]:
    """A model for each head, from a bounded sample of labelled documents."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.avg(h).alias(h) for h in HEADS])
    # Twice as many are drawn as wanted, so that ordering them takes little of each task, whatever the number of labels.
    step = max(1, known.count() // (2 * SAMPLE))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = rows.mapInArrow(_sampled, "doc_id long, features array<int>, quality double, toxic double").orderBy("doc_id").limit(SAMPLE).toArrow()
    column = sample["features"].combine_chunks()
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    each = [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    return {h: fit(each, np.asarray(sample[h].to_numpy(), np.float64)) for h in HEADS}


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = model.value
        for batch in batches:
            for block, doc, feature in _featured(batch.column("text")):
                part = batch.slice(block.first, block.n_docs)
                words = np.diff(block.bounds)
                out = []
                for h in HEADS:
                    weights, bias = heads[h]
                    sums = np.bincount(doc, weights[feature], block.n_docs)
                    out.append(pa.array(np.where(words > 0, sums, 0) + bias))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), *out], names=["doc_id", "host", "path", "quality_odds", "toxic_odds"])

    return run


def _strength(sites: DataFrame, s: Column, rate: Column) -> float:
    """Prior strength: how many documents the prior is worth, from the variance between sites beyond chance."""
    n, share, r = F.col("n"), F.col("s") / F.col("n"), F.col("rate")
    row = sites.select(F.col("n"), s.alias("s"), rate.alias("rate")).agg(
        F.sum(n * (share - r) ** 2), F.sum(n).cast("double"), F.sum(n * n).cast("double"), F.count(F.lit(1)), F.sum(n * r * (1 - r)) / F.sum(n)
    ).first()
    if not row[1] or row[3] < 2 or not row[4]:
        return MOST_STRENGTH
    between = (row[0] - row[4] * (row[3] - 1)) / max(row[1] - row[2] / row[1], 1e-9)
    return MOST_STRENGTH if between <= 0 else min(MOST_STRENGTH, max(1.0, row[4] / between - 1))


def _logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(held / (1 - held))


def posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, quality, toxicity (posterior probabilities), keep."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(h).cast("double").alias(h) for h in HEADS])
    model = spark.sparkContext.broadcast(train(slim, labels))
    scored = shared.written(slim.mapInArrow(_score(model), "doc_id long, host string, path string, quality_odds double, toxic_odds double"), "scores")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.avg(h).alias(h) for h in HEADS])
    rows = scored.join(small(known), "doc_id", "left")
    soft = {h: F.coalesce(h, 1 / (1 + F.exp(-F.col(f"{h}_odds")))) for h in HEADS}
    rows = rows.select("doc_id", F.coalesce("host", F.lit("\0")).alias("host"), F.coalesce("path", F.lit("\0")).alias("path"), "quality_odds", "toxic_odds", *[soft[h].alias(f"p_{h}") for h in HEADS])
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(f"p_{h}").alias(f"s_{h}") for h in HEADS]]
    paths = shared.written(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{h}").alias(f"s_{h}") for h in HEADS])
    total = hosts.agg(F.sum("n"), *[F.sum(f"s_{h}") for h in HEADS]).first()
    if not total[0]:
        return rows.select("doc_id", F.lit(0.0).alias("quality"), F.lit(0.0).alias("toxicity"), F.lit(False).alias("keep"))
    rates = {h: min(max(total[i + 1] / total[0], 1e-6), 1 - 1e-6) for i, h in enumerate(HEADS)}
    n = F.col("n")
    for h in HEADS:
        strength = _strength(hosts, F.col(f"s_{h}"), F.lit(rates[h]))
        hosts = hosts.withColumn(f"host_{h}", (F.col(f"s_{h}") + strength * rates[h]) / (n + strength))
    sites = paths.join(small(hosts.select("host", *[f"host_{h}" for h in HEADS])), "host")
    for h in HEADS:
        strength = _strength(sites, F.col(f"s_{h}"), F.col(f"host_{h}"))
        sites = sites.withColumn(f"k_{h}", F.lit(strength))
    out = rows.join(small(sites), ["host", "path"])
    found = {}
    for h in HEADS:
        own = F.col(f"p_{h}")
        prior = (F.col(f"s_{h}") - own + F.col(f"k_{h}") * F.col(f"host_{h}")) / (n - 1 + F.col(f"k_{h}"))
        odds = F.col(f"{h}_odds") + _logit(prior) - math.log(rates[h] / (1 - rates[h]))
        found[h] = 1 / (1 + F.exp(-odds))
    out = out.select("doc_id", found["quality"].alias("quality"), found["toxic"].alias("toxicity"))
    return out.withColumn("keep", (F.col("quality") >= 0.5) & (F.col("toxicity") < 0.5))
