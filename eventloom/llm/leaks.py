"""Benchmark decontamination by suffix arrays over shards of the documents.

A shard is a bounded run of documents inside one task. Its words become numbers (0 for a word that no benchmark item
holds, and between documents; words are told apart by their bytes), and its suffixes are sorted: the suffix array. Those
that begin with 0 would all come first and match nothing; they are left out. Every test suffix is then looked up by
binary search, all of them at once, by its first ``n`` words. The interval gives all places where these stand verbatim.

The full length of each match, and where in which item it is, come from one more suffix array: of the windows at the hit
places and those of the benchmark together. A hit's longest match is with a neighbour of it there, and its length is
found by the ranks of prefix doubling, so that long matches cost no more than others.

A *window* is ``n`` consecutive words of an item, or the whole item where it has fewer (but not none).

The documents are never shuffled. The benchmark reaches the tasks in blocks of at most ``BLOCK_BYTES`` of text; a larger
benchmark takes several passes, with the state written to the shared folder in between.

Edge cases: null or empty texts have no words and no hits; items without words have no windows; items of one id are one
item; windows of an item with a null id are hit but name no item; repeated documents give repeated rows; an empty
benchmark hits nothing; of equally long matches the first in the document counts. Words and texts of any length are used
whole. :func:`clean` keeps all columns whatever their names; in :func:`scan` the columns ``leak_*`` replace such columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, textblock

BLOCK_BYTES = 16 << 20
SHARD_BYTES = 1 << 20
#: Words are maximal runs of other bytes, after folding A-Z.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


@dataclass
class Windows:
    """The distinct windows of a benchmark block, in the numbering of its words."""

    n: int
    vocabulary: pa.Array  # word k + 1 is vocabulary[k]
    symbols: np.ndarray  # all items, with a 0 after each
    at: np.ndarray  # a place of each window in symbols
    sizes: np.ndarray
    item_bounds: np.ndarray  # the items of window w: items[item_bounds[w]:item_bounds[w + 1]]
    items: list[str]
    item_of: np.ndarray
    sequence: np.ndarray  # the window of n words that starts at each place of symbols, or -1
    owner: np.ndarray  # the number of the item's name at each place of symbols, or -1
    word: np.ndarray  # the place in its item

    @staticmethod
    def of(ids: list, texts: list[str | None], n: int) -> Windows:
        names = sorted({str(i) for i in ids if i is not None})
        number = {x: k for k, x in enumerate(names)}
        parts = list(textblock.blocks(pa.array(texts, pa.large_string()), textblock.word_table(SEPARATORS), True, 1 << 62))
        codes, vocabulary = parts[0].distinct() if parts else (np.zeros(0, np.int64), pa.array([], pa.large_binary()))
        bounds = parts[0].bounds if parts else np.zeros(1, np.int64)
        lengths = np.diff(bounds)
        symbols = np.zeros(len(codes) + len(lengths), np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        symbols[np.arange(len(codes)) + doc] = codes.astype(np.int64) + 1
        first = bounds[:-1] + np.arange(len(lengths))
        counts = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(lengths)), counts)
        at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        sizes = np.minimum(lengths[owner], n)
        keys = np.stack([np.where(j < sizes, symbols[np.minimum(at + j, len(symbols) - 1)], 0) for j in range(n)], 1) if len(at) else np.zeros((0, n), np.int64)
        _, one, window = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        window = window.reshape(-1)
        item = np.array([-1 if i is None else number[str(i)] for i in ids], np.int64)
        both = np.unique(np.stack([window, item[owner]], 1)[item[owner] >= 0], axis=0) if len(at) else np.zeros((0, 2), np.int64)
        sequence, names_at, word = (np.full(len(symbols), -1, np.int64) for _ in range(3))
        sequence[at[sizes == n]] = window[sizes == n]
        names_at[at], word[at] = item[owner], at - first[owner]
        return Windows(n, vocabulary, symbols, at[one], sizes[one], np.searchsorted(both[:, 0], np.arange(len(one) + 1)), names, both[:, 1], sequence, names_at, word)


class SuffixArray:
    """The suffixes of ``symbols`` that begin at ``places``, ordered by their first ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, places: np.ndarray, depth: int, size: int):
        self.depth, self.bits = depth, max(1, size.bit_length())
        self.symbols = symbols
        keys = self.keys(symbols, places)
        order = np.lexsort(keys[::-1])
        self.places, self.sorted = places[order], [k[order] for k in keys]

    def keys(self, symbols: np.ndarray, places: np.ndarray, sizes: np.ndarray | None = None, fill: int = 0) -> list[np.ndarray]:
        """``depth`` symbols from each place as a few 64-bit numbers; beyond ``sizes`` they are all ``fill``."""
        per = max(1, 63 // self.bits)
        out = [np.zeros(len(places), np.int64) for _ in range(math.ceil(self.depth / per))]
        for j in range(self.depth):
            there = places + j
            got = np.where(there < len(symbols), symbols[np.minimum(there, len(symbols) - 1)], 0)
            got = got if sizes is None else np.where(j < sizes, got, fill)
            out[j // per] = (out[j // per] << self.bits) | got
        return out

    def bound(self, keys: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all keys at once: the first suffix not below (``after``: above) each."""
        low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(self.places), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            probe = np.minimum(middle, len(self.places) - 1)
            less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
            for mine, key in zip(self.sorted, keys, strict=True):
                less |= same & (mine[probe] < key)
                same &= mine[probe] == key
            right = open_ & (less | same if after else less)
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        return low

    def find(self, symbols: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the pattern, place) of every occurrence of the patterns ``symbols[at:at + sizes]``."""
        low = self.bound(self.keys(symbols, at, sizes), False)
        high = self.bound(self.keys(symbols, at, sizes, (1 << self.bits) - 1), True)
        count = high - low
        pattern = np.repeat(np.arange(len(at)), count)
        return pattern, self.places[np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]


def longest(own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``own`` the length of the longest run from there that also stands in ``others``, and where.

    Numbers below 0 match nothing. Both sequences share one suffix array, by prefix doubling; of each place the nearest
    suffixes of ``others`` on either side are compared, from long runs of equal ranks to short ones.
    """
    both = np.concatenate([others, [-1], own, [-1]])
    whole = np.zeros(len(both) + 1, np.int64)  # how many numbers from a place on are not below 0
    stops = np.flatnonzero(both < 0)
    whole[:-1] = np.append(stops, len(both))[np.searchsorted(stops, np.arange(len(both)))] - np.arange(len(both))
    rank, step, ranks = np.append(np.maximum(both + 1, 0), 0), 1, []
    while True:
        ranks.append(rank)
        more = np.flatnonzero(whole > step)
        if not len(more):
            break
        after = np.zeros(len(rank), np.int64)
        after[more] = rank[more + step] + 1
        rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1].reshape(-1).astype(np.int64)
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    is_other = order < len(others)
    seen = np.where(is_other, np.arange(len(order)), -1)
    before = np.maximum.accumulate(seen)
    later = np.where(is_other, np.arange(len(order)), len(order))
    later = np.minimum.accumulate(later[::-1])[::-1]
    mine = np.flatnonzero((order > len(others)) & (order <= len(others) + len(own)))
    best, where = np.zeros(len(own), np.int64), np.full(len(own), -1, np.int64)
    for near in (before, later):
        there = near[mine]
        ok = (there >= 0) & (there < len(order))
        x, y = order[mine[ok]], order[there[ok]]
        length = np.zeros(len(x), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            a, b = np.minimum(x + length, len(both)), np.minimum(y + length, len(both))
            fits = (whole[a] >= 1 << k) & (whole[b] >= 1 << k) & (ranks[k][a] == ranks[k][b])
            length += np.where(fits, 1 << k, 0)
        at = x - len(others) - 1
        gain = length > best[at]
        best[at[gain]], where[at[gain]] = length[gain], y[gain]
    return best, where


def search(block: textblock.Block, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: (word, window, full match length, place of the match in the items) of all places where windows occur."""
    none = np.zeros(0, np.int64)
    if not len(windows.at) or not len(block.starts):
        return none, none, none, none
    codes, words = block.distinct()
    known = np.asarray(pc.fill_null(pc.index_in(words, value_set=windows.vocabulary), -1)).astype(np.int64)[codes] + 1
    symbols = np.zeros(len(known) + block.n_docs + 1, np.int64)
    symbols[np.arange(len(known)) + block.docs_of_words()] = known
    array = SuffixArray(symbols, np.flatnonzero(symbols), windows.n, len(windows.vocabulary) + 1)
    window, place = array.find(windows.symbols, windows.at, windows.sizes)
    length, where = windows.sizes[window], windows.at[window]
    full = np.flatnonzero(length == windows.n)
    full = full[np.argsort(place[full])]  # one window of n words at a place
    if len(full):
        gap = np.flatnonzero(np.diff(place[full]) > 1) + 1
        run, there = longest(np.insert(window[full], gap, -1), windows.sequence)
        kept = np.ones(len(run), bool)
        kept[gap + np.arange(len(gap))] = False
        length[full], where[full] = run[kept] + windows.n - 1, there[kept]
    starts = block.bounds[:-1] + np.arange(block.n_docs)
    return place - (np.searchsorted(starts, place, side="right") - 1), window, length, where


_WHERE = "struct<item:string,item_word:long,doc_word:long>"
_STATE = f"leak_words long, leak_ranges array<long>, leak_items array<string>, leak_longest long, leak_where {_WHERE}"
_NAMES = [f.split()[0] for f in _STATE.split(", ")]


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """The union of ranges that are sorted by their starts, as starts and ends in turn."""
    upto = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > upto[:-1]]))
    return np.stack([starts[first], np.append(upto[first[1:] - 1], upto[-1])], 1).reshape(-1).tolist()


def _scan(windows, text: str, carried: list[str], merge: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textblock.forget()
        textblock.frugal()
        index: Windows = windows.value
        for batch in batches:
            for block in textblock.blocks(batch.column(text), textblock.word_table(SEPARATORS), True, SHARD_BYTES):
                words, window, length, where = search(block, index)
                doc = np.searchsorted(block.bounds, words, side="right") - 1
                order = np.lexsort((words, doc))
                words, window, length, where, doc = words[order], window[order], length[order], where[order], doc[order]
                cuts = np.searchsorted(doc, np.arange(block.n_docs + 1)).tolist()
                part = batch.slice(block.first, block.n_docs)
                old = part.select(_NAMES).to_pylist() if merge else None
                state: list[list] = [[], [], [], []]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    ranges, names, best, place = ([], [], 0, None) if not merge else (old[i]["leak_ranges"], old[i]["leak_items"], old[i]["leak_longest"], old[i]["leak_where"])
                    if b > a:
                        at = words[a:b] - block.bounds[i]
                        ranges = ranges + _merged(at, at + index.sizes[window[a:b]])
                        found = np.unique(window[a:b])
                        items = np.unique(np.concatenate([index.item_of[index.item_bounds[w] : index.item_bounds[w + 1]] for w in found.tolist()]))
                        names = sorted({*names, *(index.items[k] for k in items.tolist())})
                        top = int(np.argmax(length[a:b]))
                        if length[a + top] > best:
                            best, owner = int(length[a + top]), int(index.owner[where[a + top]])
                            place = {"item": index.items[owner] if owner >= 0 else None, "item_word": int(index.word[where[a + top]]), "doc_word": int(at[top])}
                    for column, value in zip(state, (ranges, names, best, place), strict=True):
                        column.append(value)
                kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64())])]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], pa.array(np.diff(block.bounds), pa.int64()), *[pa.array(c, k) for c, k in zip(state, kinds, strict=True)]], names=[*carried, *_NAMES])

    return run


def _scanned(docs: DataFrame, benchmark: DataFrame, carried: list[str], n: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The carried columns as ``c0, c1, ...``, whatever their names, and the columns of the state."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / (BLOCK_BYTES // 2)))
    names = [f"c{i}" for i in range(len(carried))]
    state = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carried, names, strict=True)], F.col(f"`{text_col}`").alias("t"))
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        rows = part.collect()  # at most about BLOCK_BYTES of text
        windows = spark.sparkContext.broadcast(Windows.of([r[0] for r in rows], [r[1] for r in rows], n))
        kept = names if k == n_blocks - 1 else [*names, "t"]
        out = T.StructType([*[state.schema[c] for c in kept], *T._parse_datatype_string(_STATE).fields])
        state = state.mapInArrow(_scan(windows, "t", kept, k > 0), out)
        if k < n_blocks - 1:
            state = shared.written(state, "leaks")
    return state


def scan(docs: DataFrame, benchmark: DataFrame, carried: list[str], n: int = 8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The columns ``carried`` of every document, with

    ``leak_words`` (words of the document), ``leak_ranges`` (start, end of stretches of hit words), ``leak_items`` (sorted
    ids, as strings, of items with occurring windows), ``leak_longest`` (words of the longest verbatim match),
    ``leak_where`` (its item, the word where it starts there, and the word where it starts in the document).
    """
    carried = [c for c in carried if c not in _NAMES]
    found = _scanned(docs, benchmark, carried, n, text_col, item_col, item_text_col)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *_NAMES)


def covered(ranges: str = "leak_ranges") -> F.Column:
    """How many words the ranges cover: the union's length, from ranges in any order."""
    pairs = f"array_sort(transform(sequence(0, size({ranges}) div 2 - 1), i -> struct({ranges}[2*i] as a, {ranges}[2*i+1] as b)))"
    start = "struct(0L as n, 0L as upto)"
    step = "(s, r) -> struct(s.n + greatest(0L, r.b - greatest(r.a, s.upto)) as n, greatest(s.upto, r.b) as upto)"
    return F.expr(f"if(size({ranges}) = 0, 0L, aggregate({pairs}, {start}, {step}).n)")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", n: int = 8, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    found = scan(docs, benchmark, [id_col], n)
    count = F.size("leak_items").cast("long")
    return found.select(
        id_col,
        F.col("leak_words").alias("n_words"),
        covered().alias("n_hit"),
        count.alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("leak_items")), 256).alias("items_sha256"),
        (count >= least_items).alias("contaminated"),
        F.col("leak_longest").alias("longest"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 8, least_items: int = 1) -> DataFrame:
    """The documents with verbatim windows of fewer than ``least_items`` items; columns as before."""
    found = _scanned(docs, benchmark, docs.columns, n, "text", "item_id", "text")
    return found.where(F.size("leak_items") < least_items).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
