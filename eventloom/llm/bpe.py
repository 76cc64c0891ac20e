"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string the greedy merge procedure ends in exactly one last token. So a table with one
token for each prefix holds the encodings of *all* prefixes: appending bytes only adds entries, and after an edit the
table is recomputed from the edit until it agrees with the old one over a whole token length.

The last token of a prefix is the only token that (a) is a suffix of it and (b) may follow the last token of what
stands before. Whether ``b`` may follow ``a`` is decided by undoing their merges along the seam
(:meth:`PrefixCoder.may_follow`) and remembered.

Edge cases: null and empty texts encode to no ids. Texts are encoded whole whatever their length; long pre-tokens cost
time in proportion to their bytes. Other columns are passed through by :func:`encode`, whose output columns replace
input columns of the same name. Repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pretoken, textblock

#: Words remembered by a worker before it starts afresh, and their bytes; bounds memory, not results.
CACHE_WORDS, CACHE_BYTES = 500_000, 1 << 24
PAIR_CACHE = 1 << 18
#: Bytes of text that :func:`encode` cuts at a time; some fifty times as much is held meanwhile.
ENCODE_BYTES = 1 << 18


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Reads the lines ``base64(token) rank`` of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class PrefixCoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self._follow: dict[int, bool] = {}
        lengths = np.array([len(t) for t in self.tokens])
        self._blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._lengths, self._at = lengths, np.cumsum(lengths) - lengths

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
            while len(parts) > 2:
                made = [self.ranks.get(self.tokens[x] + self.tokens[y], token) for x, y in zip(parts, parts[1:], strict=False)]
                best = min(made)
                at = made.index(best)
                if best >= token:
                    raise ValueError(f"token {token} is not reachable by merges")
                parts[at : at + 2] = [best]
            self._halves[token] = (parts[0], parts[1])
        return self._halves[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together still encode as ``[a, b]``.

        Going back in time, the seam separates ever smaller pieces. Two pieces x|y stood next to each other until
        one of them was merged into its parent; had merging x and y come earlier (or as early, when the competing
        merge lies further right), the seam would have closed.
        """
        key = a * self.size + b
        known = self._follow.get(key)
        if known is None:
            known = self._check(a, b)
            if len(self._follow) >= PAIR_CACHE:
                self._follow.clear()
            self._follow[key] = known
        return known

    def _check(self, x: int, y: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        left_until = right_until = self.size
        while True:
            across = ranks.get(tokens[x] + tokens[y])
            if across is not None and across < left_until and across <= right_until:
                return False
            x_made, y_made = len(tokens[x]) > 1, len(tokens[y]) > 1
            if not (x_made or y_made):
                return True
            if x_made and (not y_made or x > y):
                left_until, x = x, self.halves(x)[1]
            else:
                right_until, y = y, self.halves(y)[0]

    def extend(self, word: bytes, last: list[int]) -> None:
        """Adds to ``last`` (one token for each prefix known so far) the entries up to the end of ``word``."""
        ranks, longest, may_follow = self.ranks, self.longest, self.may_follow
        for end in range(len(last) + 1, len(word) + 1):
            for begin in range(max(0, end - longest), end):
                token = ranks.get(word[begin:end])
                if token is not None and (not begin or may_follow(last[begin - 1], token)):
                    last.append(token)
                    break

    def walk(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of a prefix, read from the table backwards."""
        end, out = len(last) if end is None else end, []
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if word in self.ranks:
            return [self.ranks[word]]
        last: list[int] = []
        self.extend(word, last)
        return self.walk(last)

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids end to end, and the running end of each id's bytes."""
        sizes = self._lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self._blob[np.repeat(self._at[ids] - ends + sizes, sizes) + np.arange(total)], ends

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


class PrefixTable:
    """An editable encoding of one pre-token's bytes."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.coder.extend(self.data, self.last)

    def ids(self, end: int | None = None) -> list[int]:
        return self.coder.walk(self.last, end)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` in place of ``data[start:end]``; returns how many entries were recomputed."""
        old, tail = self.last, self.data[end:]
        self.data = self.data[:start] + new + tail
        self.last = old[:start]
        edited, shift, same = start + len(new), len(new) - (end - start), 0
        for at in range(start, len(self.data)):
            self.coder.extend(self.data[: at + 1], self.last)
            same = same + 1 if at >= edited and self.last[at] == old[at - shift] else 0
            if same >= self.coder.longest:
                self.last += old[at + 1 - shift :]
                return at + 1 - start
        return len(self.data) - start


class Codebook:
    """The distinct words that a worker has encoded: their ids, and the ids in decimal, end to end in flat arrays.

    It starts afresh beyond CACHE_WORDS words or CACHE_BYTES of them, which bounds its memory and changes no result.
    """

    def __init__(self, encode, with_decimals: bool):
        self.encode, self.with_decimals = encode, with_decimals  # encode: from an array of words to lists of ids
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.n_bytes = 0
        self.ids, self.decimals = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.id_bounds, self.decimal_bounds = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The place of each word; words not met before are encoded."""
        keys = words.to_pylist()
        known = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(known < 0)
        fresh = sum(len(keys[i]) for i in missing.tolist())
        if len(missing) and (len(self.number) + len(missing) > CACHE_WORDS or self.n_bytes + fresh > CACHE_BYTES):
            self.clear()
            missing, fresh = np.arange(len(keys)), sum(map(len, keys))
        if len(missing):
            self.n_bytes += fresh
            known[missing] = np.arange(len(self.number), len(self.number) + len(missing))
            self.number.update(zip([keys[i] for i in missing.tolist()], known[missing].tolist(), strict=True))
            found = self.encode(words.take(pa.array(missing)))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
            self.id_bounds = np.append(self.id_bounds, self.id_bounds[-1] + np.cumsum(sizes))
            if self.with_decimals:
                texts = [("".join([f" {i}" for i in ids])).encode() for ids in found]
                self.decimals = np.concatenate([self.decimals, np.frombuffer(b"".join(texts), np.uint8)])
                self.decimal_bounds = np.append(self.decimal_bounds, self.decimal_bounds[-1] + np.cumsum([len(t) for t in texts]))
        return known

    def of(self, block: textblock.Block) -> np.ndarray:
        """The place of each word of a block."""
        codes, words = block.distinct()
        return self.numbers(words)[codes]

    def id_rows(self, places: np.ndarray, block: textblock.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids in text order, and the bounds of the block's documents in them."""
        ids, ends = textblock.gathered(self.ids, self.id_bounds[places], self.id_bounds[places + 1])
        return ids, ends[block.bounds]

    def decimal_rows(self, places: np.ndarray, block: textblock.Block) -> tuple[np.ndarray, np.ndarray]:
        """The same in decimal, with a space before each id."""
        data, ends = textblock.gathered(self.decimals, self.decimal_bounds[places], self.decimal_bounds[places + 1])
        return data, ends[block.bounds]


def coder_of(raw: bytes, with_decimals: bool = True) -> tuple[PrefixCoder, Codebook]:
    """The coder of a rank file and the words it has encoded, kept by the worker until it runs another operator."""

    def made():
        coder = PrefixCoder(load_ranks(raw))
        return coder, Codebook(lambda words: [coder.encode(w) for w in words.to_pylist()], with_decimals)

    return textblock.kept(("bpe", hashlib.sha256(raw).digest(), with_decimals), made)


def _sha256s(data: np.ndarray, bounds: np.ndarray, skip: int) -> list[str]:
    at = bounds.tolist()
    return [hashlib.sha256(data[min(a + skip, b) : b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]


def _digests(raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, book = coder_of(raw)
        for batch in batches:
            keys = batch.column(0)
            for block in pretoken.blocks(batch.column(1)):
                places = book.of(block)
                ids, bounds = book.id_rows(places, block)
                back, ends = coder.decode_flat(ids)
                arrays = [keys.slice(block.first, block.n_docs), pa.array(np.diff(bounds)), pa.array(_sha256s(*book.decimal_rows(places, block), 1)), pa.array(_sha256s(back, np.concatenate([[0], ends])[bounds], 0))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _share(df: DataFrame, vocabulary: str):
    """The rank file's bytes (a vocabulary of fixed size) for the executors, which need not see the driver's path."""
    with open(vocabulary, "rb") as f:
        return f.read()


def _encoded(raw: bytes, keep: list[str], text_col: str, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textblock.frugal()
        _, book = coder_of(raw, False)
        for batch in batches:
            for block in pretoken.blocks(batch.column(text_col), ENCODE_BYTES):
                ids, bounds = book.id_rows(book.of(block), block)
                arrays = [batch.column(c).slice(block.first, block.n_docs) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], names=[*keep, ids_col])

    return run


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with an ``array<int>`` of token ids (never null). No shuffle; streams batches."""
    keep = [c for c in df.columns if c != ids_col]
    source = df.select(list(dict.fromkeys([*keep, text_col])))
    return source.mapInArrow(_encoded(_share(df, vocabulary), keep, text_col, ids_col), T.StructType([*df.select(keep).schema, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes (``binary``) of its ids; null ids decode to no bytes."""
    raw = _share(df, vocabulary)
    keep = [c for c in df.columns if c != out_col]

    def run(batches):
        coder, _ = coder_of(raw)
        for batch in batches:
            rows = batch.column(ids_col).to_pylist()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([coder.decode(x or []) for x in rows], pa.binary())], names=[*keep, out_col])

    return df.select(keep).mapInArrow(run, T.StructType([*df.select(keep).schema, T.StructField(out_col, T.BinaryType())]))


def digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: id, n_tokens, ids_sha256, decoded_sha256. No shuffle."""
    raw = _share(df, vocabulary)
    slim = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_digests(raw), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("doc_id", id_col)
