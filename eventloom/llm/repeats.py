"""Removal of long verbatim repeats with FM-indexes over shards.

A window is ``n`` consecutive words of a document. A word goes if a window that covers it also starts in a document with
a smaller id.

1. Later copies of equal texts (by SHA-256) are set aside: all their windows have been seen.
2. Each window has a *minimiser*, the word 5-gram in it with the least hash; equal windows have equal minimisers. Only
   minimisers found in several documents can belong to a repeat. They are counted over the whole corpus; about a fifth
   of the positions are minimisers, so this shuffles far less than all windows would.
3. Runs of windows around one such minimiser become *pieces* (at most 21 words). Equal pieces are merged, keeping the
   smallest document id, before they are dealt to shards by their minimiser, which brings equal windows together.
   The windows of a minimiser in very many documents become pieces of their own, so that no shard grows with it.
4. Each shard builds an FM-index of its pieces and streams them through it: backward search gives, for each last word,
   the longest match that stands in a smaller document (matching statistics). Matches of ``n`` words or more are kept.
   Words of a shard are told apart by their bytes.
5. Documents that hold a window of a smaller document's lose those words.

Edge cases: null and empty texts have no words; documents of fewer than ``n`` words lose nothing; windows repeated
within one id, or in rows of the same id, are no repeats; rows with a null id lose nothing and make others lose nothing;
words of any length and texts of any length are used whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textblock
from .fmindex import FMIndex
from .jaccard import small

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
GRAM = 5
#: Documents a minimiser may be in before its windows are dealt one by one.
HOT_DOCS = 5000
#: Pieces of a shard, as a mean; a minimiser adds HOT_DOCS pieces at most.
SHARD_PIECES = 20_000
#: Minimisers (8 bytes each) to broadcast; more are brought to their documents by a shuffle.
BROADCAST_KEYS = 4_000_000


def _blocks_of(texts):
    return textblock.blocks(texts, textblock.word_table(SEPARATORS))


def minimisers(block: textblock.Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, place of its minimiser, the hash of every word 5-gram in the block)."""
    grams = textblock.gram_hashes(block.hashes(), GRAM, seed=11)
    lengths = np.diff(block.bounds)
    counts = np.maximum(lengths - n + 1, 0)
    at = np.repeat(block.bounds[:-1] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    if not len(at):
        return at, at, grams
    best, place = grams[at], at.copy()
    for j in range(1, n - GRAM + 1):
        other = grams[at + j]
        less = other < best
        best, place = np.where(less, other, best), np.where(less, at + j, place)
    return at, place, grams


def _keys(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for block in _blocks_of(batch.column("text")):
                _, place, grams = minimisers(block, n)
                place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
                doc = np.searchsorted(block.bounds, place, side="right") - 1
                keys = grams[place].view(np.int64)
                order = np.lexsort((keys, doc))
                doc, keys = doc[order], keys[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]) if len(doc) else np.zeros(0, bool)
                doc, keys = doc[new], keys[new]
                bounds = np.searchsorted(doc, np.arange(block.n_docs + 1))
                yield pa.RecordBatch.from_arrays([ids.slice(block.first, block.n_docs), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys))], names=["doc_id", "keys"])

    return run


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as a binary array."""
    sizes = ends - starts
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    out = data[np.repeat(starts - stops + sizes, sizes) + np.arange(total)]
    offsets = np.concatenate([[0], stops]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])


def _normal(block: textblock.Block) -> tuple[np.ndarray, np.ndarray]:
    """The words joined by one space each, and where each starts (with the end)."""
    sizes = block.ends - block.starts + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    total = int(starts[-1])
    shift = np.repeat(block.starts - starts[:-1], sizes)
    source = np.minimum(np.arange(total) + shift, max(len(block.data) - 1, 0))
    out = block.data[source] if total else np.zeros(0, np.uint8)
    out[starts[1:] - 1] = 0x20
    return out, starts


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _pieces(n: int, tables):
    """Cuts documents into pieces; ``tables``: broadcast (keys, hot keys), or None if each row has its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks_of(batch.column("text")):
                at, place, grams = minimisers(block, n)
                values = grams[place].view(np.int64)
                doc = np.searchsorted(block.bounds, at, side="right") - 1
                if tables is not None:
                    live, hot = (_member(values, t) for t in tables.value)
                else:
                    live, hot = np.zeros(len(at), bool), np.zeros(len(at), bool)
                    cut = np.searchsorted(doc, np.arange(block.n_docs + 1))
                    for name, mask in (("keys", live), ("hot", hot)):
                        own = batch.column(name)
                        for i in range(block.n_docs):
                            a, b = cut[i], cut[i + 1]
                            keys = own[block.first + i].as_py()
                            if b > a and keys:
                                mask[a:b] = _member(values[a:b], np.sort(np.array(keys, np.int64)))
                at, place, values, doc, hot = (x[live] for x in (at, place, values, doc, hot))
                if not len(at):
                    continue
                first = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1) | hot[1:] | hot[:-1]])
                first = np.flatnonzero(first)
                count = np.diff(np.append(first, len(at)))
                data, starts = _normal(block)
                begin, end = at[first], at[first] + count + n - 1
                alone = hot[first]
                key = values[first]
                if alone.any():
                    own = textblock.gram_hashes(block.hashes(), n, seed=12).view(np.int64)
                    key = np.where(alone, own[np.minimum(begin, len(own) - 1)], key)
                rows = pa.array(block.first + doc[first])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("tid").take(rows), pa.array(begin - block.bounds[doc[first]], pa.int32()), pa.array(key), _gather(data, starts[begin], starts[end] - 1)], names=["doc_id", "tid", "start", "key", "piece"])

    return run


def _shard(n: int):
    def run(table: pa.Table) -> pa.Table:
        pieces = table["piece"].combine_chunks().cast(pa.large_binary())
        data, offsets = textblock.as_bytes(pieces)
        text = pa.Array.from_buffers(pa.large_string(), len(pieces), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        block = next(textblock.blocks(text, textblock.word_table(b" "), limit=1 << 62))
        words, lengths = block.distinct()[0].astype(np.int64), np.diff(block.bounds)
        owners = np.unique(np.asarray(table["doc"]), return_inverse=True)[1].reshape(-1).astype(np.int32)
        which, last, size = FMIndex(words, lengths, owners).statistics(words, lengths, owners, n)
        # the windows within a match, as their first words; a window in several matches is given once
        counts = size - n + 1
        piece = np.repeat(which, counts)
        at = np.repeat(last - size + 1, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        found = np.unique(piece * (1 << 32) + at)
        bounds = np.searchsorted(found >> 32, np.arange(len(pieces) + 1)).astype(np.int32)
        gone = pa.ListArray.from_arrays(pa.array(bounds), pa.array((found & 0xFFFFFFFF).astype(np.int32)))
        return pa.table([table["key"], table["pid"], table["doc"], pa.array(lengths - n + 1, pa.int32()), gone], names=["key", "pid", "doc", "windows", "own"])

    return run


def _cut(n: int, with_text: bool):
    """Removes words; column ``gone``: windows (first words), or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks_of(batch.column("text")):
                data, starts = _normal(block)
                gone = batch.column("gone").slice(block.first, block.n_docs).to_pylist()
                words, removed, shas, kept_texts = np.diff(block.bounds).tolist(), [], [], []
                for i, windows in enumerate(gone):
                    a, b = int(block.bounds[i]), int(block.bounds[i + 1])
                    if windows:
                        change = np.zeros(b - a + 1, np.int64)
                        np.add.at(change, np.array(windows), 1)
                        np.add.at(change, np.minimum(np.array(windows) + n, b - a), -1)
                        keep = np.flatnonzero(np.cumsum(change[:-1]) == 0) + a
                        removed.append(b - a - len(keep))
                        kept = b" ".join([data[starts[k] : starts[k + 1] - 1].tobytes() for k in keep.tolist()])
                    else:
                        removed.append(0)
                        kept = data[starts[a] : starts[b] - 1].tobytes() if b > a else b""
                    shas.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_texts.append(kept.decode())
                part = [batch.column(c).slice(block.first, block.n_docs) for c in batch.schema.names if c not in ("text", "gone")]
                names = [c for c in batch.schema.names if c not in ("text", "gone")]
                more = [pa.array(kept_texts, pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays([*part, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas), *more], names=[*names, "n_words", "n_removed", "kept_sha256", *["kept"][: len(more)]])

    return run


def windows(docs: DataFrame, n: int, work: shared.Work) -> DataFrame:
    """``docs(doc_id, text, tid)``, texts distinct: doc_id, tid, gone (first words of windows of smaller documents)."""
    spark = docs.sparkSession
    keys = docs.mapInArrow(_keys(n), "doc_id long, keys array<long>").select("doc_id", F.explode("keys").alias("key"))
    seen = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("c")).where("a < b")
    seen = work.written(seen.select("key", (F.col("c") > HOT_DOCS).alias("hot")), "minimisers")
    schema = "doc_id long, tid long, start int, key long, piece binary"
    if seen.count() <= BROADCAST_KEYS:
        rows = seen.toArrow()
        values, hot = np.asarray(rows["key"].combine_chunks()), np.asarray(rows["hot"].combine_chunks())
        tables = spark.sparkContext.broadcast((np.sort(values), np.sort(values[hot])))
        pieces = docs.mapInArrow(_pieces(n, tables), schema)
    else:
        own = keys.join(seen, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))
        pieces = docs.join(own, "doc_id").mapInArrow(_pieces(n, None), schema)
    pieces = work.written(pieces.withColumn("pid", _print("piece")), "pieces")
    merged = pieces.groupBy("key", "pid").agg(F.min(F.struct("doc_id", "piece")).alias("m"))
    merged = merged.select("key", "pid", F.col("m.doc_id").alias("doc"), F.col("m.piece").alias("piece"))
    shards = max(1, math.ceil(pieces.count() / SHARD_PIECES))
    dealt = merged.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard")
    found = dealt.applyInArrow(_shard(n), "key long, pid binary, doc long, windows int, own array<int>")
    rows = pieces.select("doc_id", "tid", "start", "key", "pid").join(found, ["key", "pid"])
    # A piece is whole in the smallest document that has it; only that one needs to look for others.
    gone = F.when(F.col("doc_id") > F.col("doc"), F.sequence(F.lit(0), F.col("windows") - 1)).otherwise(F.col("own"))
    rows = rows.select("doc_id", "tid", F.transform(gone, lambda i: i + F.col("start")).alias("gone")).where(F.size("gone") > 0)
    return rows.groupBy("doc_id", "tid").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def _print(column: str) -> F.Column:
    """Half of the SHA-256 of a column, as bytes."""
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def remove(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, unless ``digest_only``, kept: the words left, joined by a space."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tid"))
    work = shared.Work(docs.sparkSession)
    known = rows.where("doc_id is not null and text is not null")
    hashed = known.select("doc_id", _print("text").alias("h"))
    oldest = hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = shared.written(hashed.join(oldest, "h").where("doc_id > first").select("doc_id", "h").distinct(), "copies")
    marked = known.withColumn("h", _print("text"))
    fresh = marked.join(small(copies), ["doc_id", "h"], "left_anti").select("doc_id", "text", "tid")
    gone = shared.written(windows(fresh, n, work), "gone")
    work.clear()
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ("" if digest_only else ", kept string")
    # Texts that lose nothing are not shuffled, and copies lose all windows (hence all words, if they have a window).
    ids = small(gone.select("doc_id", "tid"))
    touched = fresh.join(ids, ["doc_id", "tid"], "left_semi").join(gone, ["doc_id", "tid"]).select("doc_id", "text", "gone")
    rest = fresh.join(ids, ["doc_id", "tid"], "left_anti").select("doc_id", "text").union(rows.where("doc_id is null or text is null").select("doc_id", "text"))
    rest = rest.select("doc_id", "text", F.lit(None).cast("array<int>").alias("gone"))
    twins = marked.join(small(copies), ["doc_id", "h"], "left_semi").select("doc_id", "text", F.lit(None).cast("array<int>").alias("gone"))
    cut = lambda d: d.mapInArrow(_cut(n, not digest_only), schema)
    emptied = cut(twins)
    full = F.col("n_words") >= n
    emptied = emptied.withColumns({"n_removed": F.when(full, F.col("n_words")).otherwise(0), "kept_sha256": F.when(full, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256"))})
    if not digest_only:
        emptied = emptied.withColumn("kept", F.when(full, F.lit("")).otherwise(F.col("kept")))
    return cut(touched).union(cut(rest)).union(emptied)
