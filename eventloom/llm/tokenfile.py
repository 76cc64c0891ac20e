"""Token ids in ORC files: written in document order, read stripe by stripe.

Layout. One directory holds ORC files in ascending order of document id; each row is a document::

    doc_id, shard int, shard_start long, n_tokens long, ids array<int>

``shard`` is the number of the writing task (range partitions of the ids, so ascending), ``shard_start`` the ids before
the row in its shard. The ids are integer run-length encoded in stripes; row indexes and a Bloom filter on the document
id let a reader skip stripes and row groups (:func:`lookup`). Offsets in the whole sequence are the sums of the shards
before, taken from the ``n_tokens`` column alone.

Texts are encoded by a ``tokenizers`` file as the library does by default. Merges never cross pre-tokens, so each distinct
pre-token of a worker is given to the library once; a text that holds one of the file's added tokens goes to it whole.

Edge cases: null or empty text holds the end id only; a null document id sorts first; repeated ids are kept, ordered by
text; an empty table gives an empty directory listing that reads as no rows; other columns are not written.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import pretoken, textblock
from .bpe import Codebook

#: Up to this many shards their offsets are broadcast (16 bytes each), beyond it they are joined by a shuffle.
BROADCAST_SHARDS = 500_000
_tokenizers: dict[str, tuple] = {}


def schema(id_type: T.DataType) -> T.StructType:
    fields = [("doc_id", id_type), ("shard", T.IntegerType()), ("shard_start", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))]
    return T.StructType([T.StructField(*f) for f in fields])


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """The letters that byte-level tokenizers write for the 256 bytes, in UTF-8 end to end, and their bounds.

    A visible byte stands for itself, the others for the letters from U+0100 on.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    letters = [chr(b if b in visible else 256 + hidden.index(b)).encode() for b in range(256)]
    return np.frombuffer(b"".join(letters), np.uint8), np.cumsum([0, *map(len, letters)])


def _lettered(words: pa.Array) -> list[str]:
    """Byte words as the tokenizer's model sees them."""
    data, bounds = textblock.as_bytes(words)
    letters, edges = _letters()
    out, ends = textblock.gathered(letters, edges[data], edges[data.astype(np.int64) + 1])
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(ends[bounds]), pa.py_buffer(out)]).to_pylist()


def _tokenizer(definition: str) -> tuple:
    """(the library's tokenizer, its added tokens, the codebook of known pre-tokens), kept for the worker's life.

    Pre-tokens go straight to the library's model where the file asks for nothing but the byte letters before it.
    """
    if definition not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made, found = Tokenizer.from_str(definition), json.loads(definition)
        before, model = found.get("pre_tokenizer") or {}, made.model
        if found.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space"):
            encode = lambda words: [[t.id for t in model.tokenize(w)] for w in _lettered(words)]
        else:
            encode = lambda words: [e.ids for e in made.encode_batch([w.decode() for w in words.to_pylist()], add_special_tokens=False)]
        _tokenizers[definition] = made, [t["content"] for t in found.get("added_tokens", [])], Codebook(encode, False)
    return _tokenizers[definition]


def _encoder(definition: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, added, book = _tokenizer(definition)
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            whole = np.zeros(len(texts), bool)
            for content in added:
                whole |= np.asarray(pc.fill_null(pc.match_substring(texts, content), False))
            plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
            for block in pretoken.blocks(plain):
                ids, bounds = book.id_rows(book.of(block), block)
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                apart = np.flatnonzero(whole[block.first : block.first + block.n_docs])
                if len(apart):
                    own = np.split(ids, bounds[1:-1])
                    for i in apart.tolist():
                        found = library.encode(texts[block.first + i].as_py(), add_special_tokens=False).ids
                        own[i] = np.array([*found, end_id], np.int32)
                    ids, bounds = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
                sizes = np.diff(bounds)
                arrays = [keys.slice(block.first, block.n_docs), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(before + bounds[:-1]), pa.array(sizes)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])
                before += int(bounds[-1])

    return run


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes ``df`` with the tokenizer file and writes the directory ``path``.

    The texts are dealt by ranges of the id (one shuffle, of texts rather than of the longer ids) and sorted within.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    slim = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    dealt = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(_encoder(definition, end_id), schema(slim.schema["doc_id"].dataType))
    rows.write.options(**{"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000"}).orc(path)


def read(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    return spark.read.schema(schema(id_type or T.LongType())).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; min/max, row indexes and Bloom filters skip the other stripes."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def starts(rows: DataFrame) -> DataFrame:
    """``shard, base``: ids in all shards before. Reads only the counts; one row for each file."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    return totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, shard, start, ids = batch.columns
        offsets = np.asarray(ids.offsets).tolist()
        values = np.asarray(ids.values).astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([keys, shard, start, pa.array(np.diff(np.asarray(offsets)), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def summary(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32."""
    rows = read(spark, path, id_type)
    kind = rows.schema["doc_id"].dataType.simpleString()
    each = rows.select("doc_id", "shard", "shard_start", "ids").mapInArrow(_crc, f"doc_id {kind}, shard int, shard_start long, n_tokens long, ids_crc32 long")
    bases = starts(rows)
    if rows.select("shard").distinct().limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS:
        bases = F.broadcast(bases)
    return each.join(bases, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
