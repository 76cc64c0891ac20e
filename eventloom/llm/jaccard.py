"""Exact n-gram Jaccard join, size-aware: subsets for light sets, inverted lists for heavy ones.

Two sets link when ``den * |A & B| >= num * |A | B|``. A set's cost decides its side (:func:`planned`): what its subsets
cost against what its entries in inverted lists cost, with the length of the lists as counted in the corpus.

* **light**: a linked partner lacks at most ``d`` of its ``n`` elements, so all subsets of ``n - d .. n`` elements are
  enumerated; linked sets share the key of their intersection. Within a key the smallest set links with every set that
  has any link there, so a star around it is complete.
* **heavy**: each set enters the inverted lists of its first elements in one global order, as many as it may lack and one
  more. Linked sets have their first common element among these in both. Elements of many documents come last in the
  order, the others by their hash, so that a passage that many share fills no list as long as the rest suffices. Lists
  of one set are dropped before anything else is brought to them.

Equal texts make one entry: they are united by a grouped minimum. Candidates of the lists are never enumerated pairwise:

1. In each list all are held against its smallest set, and what links is united (:mod:`components`).
2. Lists that still hold several components are dealt to tasks in blocks of bounded size. A task compares parity
   sketches (bits that bound the difference of two sets from below) across components only, and gives each set's nearest
   candidates. What links is united, twice.
3. Then all pairs across components that the sketches allow are given.

Every candidate is checked on the words of both texts, so no hash decides a link, and no link between different
components is lost.

Edge cases: null or empty texts have no elements and link with nothing (their component is their own id); texts of
fewer than ``k`` words have their whole sequence as the single element; rows of one id are one document; rows with a
null id get a null component and link with nothing; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textblock
from .components import components

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
#: 64-bit words of a set's parity sketch: enough to tell sets of a few thousand elements just below the threshold.
PARITY_WORDS = 32
#: Words of the sketch folded for the lists, where each set stands many times.
BRIEF_WORDS = 8
#: Only elements whose hash is below this are counted: those that come first in a set.
COUNTED = np.uint64(1 << 62)
#: Elements found this often in a task are reported; those found this often in all count as frequent. Any choice is right.
LEAST_IN_TASK, LEAST_FREQUENT = 2, 16
MAX_FREQUENT = 1_000_000
#: Elements below this hash are reported whatever their count: the sample that gives the mean length of the lists.
SAMPLED = np.uint64(1 << 52)
#: What holding a candidate against a set costs, in entries of a list.
CANDIDATE = 8
#: Id sets of up to this many rows (8 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Sets of a list that meet in a task at once, and rows in a task's group as a mean.
LIST_BLOCK, BUNDLE = 2048, 20_000
NEAREST_TURNS, NEAREST = 2, 2
_CHUNK_PAIRS = 1 << 17
_CHUNK_BYTES = 1 << 20


class Plan:
    """Bounds for one threshold ``num / den``; sets of up to ``light`` elements make subsets."""

    def __init__(self, num: int, den: int, light: int = 0):
        self.num, self.den, self.light = num, den, light
        self.least_heavy = max(1, -(-num * (light + 1) // den))

    def lacking(self, n: int) -> int:
        """How many elements of a set of ``n`` a linked set may lack."""
        return n - -(-self.num * n // self.den)

    def common(self, a, b):
        """The least overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def light_cost(self, n: int) -> int:
        return sum(math.comb(n, j) for j in range(self.lacking(n) + 1))

    def heavy_cost(self, n: int, others: float) -> float:
        """Entries in lists that hold ``others`` sets besides, as a mean."""
        return (self.lacking(n) + 1) * (1 + CANDIDATE * others)


def planned(num: int, den: int, others: float, most: int = 24) -> Plan:
    """The plan whose light sets are those that cost less as subsets."""
    plan, light = Plan(num, den), 0
    while light < most and plan.light_cost(light + 1) <= plan.heavy_cost(light + 1, others):
        light += 1
    return Plan(num, den, light)


def _blocks_of(texts, limit: int = textblock.SLICE_BYTES):
    return textblock.blocks(texts, textblock.word_table(SEPARATORS), lower=True, limit=limit)


def elements(block: textblock.Block, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct element hashes of each document."""
    words = block.hashes()
    grams = textblock.gram_hashes(words, k)
    for a, b in zip(block.bounds.tolist(), block.bounds[1:].tolist(), strict=False):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        else:
            yield textblock.gram_hashes(words[a:b], b - a, seed=2 + b - a) if b > a else words[a:a]


def _subsets(u: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(key, size) of every subset with up to the allowed number of elements missing."""
    mixed, n = textblock.mix(u ^ np.uint64(0xA5A5A5A5)), len(u)
    missing, sizes = [np.zeros(1, np.uint64)], [n]
    for j in range(1, plan.lacking(n) + 1):
        out = mixed[np.array(list(combinations(range(n), j)))].sum(1, dtype=np.uint64)
        missing.append(out)
        sizes += [n - j] * len(out)
    sums, sizes_ = mixed.sum(dtype=np.uint64, keepdims=True) - np.concatenate(missing), np.array(sizes)
    return textblock.mix(sums ^ (sizes_.astype(np.uint64) << np.uint64(40))), sizes_


def first_elements(u: np.ndarray, frequent: np.ndarray, plan: Plan) -> np.ndarray:
    """The elements whose lists a heavy set enters, in the global order."""
    wanted = plan.lacking(len(u)) + 1
    counted = u[: np.searchsorted(u, COUNTED)]
    if not len(frequent) or not len(counted):
        return u[:wanted]
    often = frequent[np.minimum(np.searchsorted(frequent, counted), len(frequent) - 1)] == counted
    if not often[:wanted].any():
        return u[:wanted]
    return np.concatenate([counted[~often], u[len(counted) :], counted[often]])[:wanted]


def _occurrences(k: int):
    """Counts of elements in a task: those found often, and all of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textblock.forget()
        textblock.frugal()
        kept, counts, fresh, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def compact():
            values = np.concatenate([kept, *fresh])
            weights = np.concatenate([counts, np.ones(len(values) - len(kept), np.int64)])
            found, which = np.unique(values, return_inverse=True)
            return found, np.bincount(which, weights, len(found)).astype(np.int64)

        def rows(least: int):
            sampled = kept < SAMPLED
            chosen = (counts >= least) | sampled
            return pa.RecordBatch.from_arrays([pa.array(kept[chosen].view(np.int64)), pa.array(counts[chosen]), pa.array(sampled[chosen])], names=["element", "n", "sampled"])

        for batch in batches:
            for block in _blocks_of(batch.column("text")):
                grams = textblock.gram_hashes(block.hashes(), k)
                inside = np.ones(len(grams), bool)  # no gram spans two documents
                for j in range(1, k):
                    edge = block.bounds[1:-1] - j
                    inside[edge[(edge >= 0) & (edge < len(grams))]] = False
                fresh.append(grams[inside & (grams < COUNTED)])
                size += len(fresh[-1])
                if size > 250_000:
                    (kept, counts), fresh, size = compact(), [], 0
                    if len(kept) > 750_000:  # bounds the task's memory
                        yield rows(LEAST_IN_TASK)
                        kept, counts = kept[:0], counts[:0]
        kept, counts = compact()
        yield rows(LEAST_IN_TASK)

    return run


def counted(docs: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """(sorted elements of many documents, how many other sets share an element that is not frequent, as a mean)."""
    found = docs.select("text").mapInArrow(_occurrences(k), "element long, n long, sampled boolean")
    work = shared.Work(docs.sparkSession)
    found = work.written(found.groupBy("element", "sampled").agg(F.sum("n").alias("n")), "elements")
    rows = found.where(F.col("n") >= LEAST_FREQUENT).orderBy(F.desc("n"), "element").limit(MAX_FREQUENT).select("element").toArrow()
    rare = found.where(F.col("sampled") & (F.col("n") < LEAST_FREQUENT))
    squares, total = rare.agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
    work.clear()
    return np.sort(np.asarray(rows["element"].combine_chunks()).view(np.uint64)), (squares / total - 1 if total else 0.0)


def _signatures(k: int, plan: Plan, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textblock.forget()
        textblock.frugal()
        seen, common = set(), frequent.value
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            for block in _blocks_of(batch.column("text")):
                cuts = np.append(block.starts, len(block.data))[block.bounds].tolist() if len(block.starts) else [0] * (block.n_docs + 1)
                n, prints, firsts, keys, sizes = [], [], [], [], []
                for i, u in enumerate(elements(block, k)):
                    n.append(len(u))
                    prints.append(hashlib.blake2b(block.data[cuts[i] : cuts[i + 1]].tobytes().strip(SEPARATORS), digest_size=16).digest())
                    firsts.append(None)
                    keys.append(None)
                    sizes.append(None)
                    if not len(u) or prints[-1] in seen or not known[block.first + i]:
                        continue
                    seen.add(prints[-1])
                    firsts[-1] = first_elements(u, common, plan).view(np.int64) if len(u) >= plan.least_heavy else np.zeros(0, np.int64)
                    if len(u) <= plan.light:
                        a, b = _subsets(u, plan)
                        keys[-1], sizes[-1] = a.view(np.int64), b.astype(np.int32)
                arrays = [ids.slice(block.first, block.n_docs), pa.array(n, pa.int32()), pa.array(prints, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "h", "firsts", "subsets", "sizes"])

    return run


_SIGNATURES = "doc_id long, n int, h binary, firsts array<long>, subsets array<long>, sizes array<int>"


def _parity(u: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements falls into each bucket, as bits. Sets differ in as many elements at least as
    their bits differ."""
    bits = 64 * PARITY_WORDS
    odd = np.bincount((u >> np.uint64(30)) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textblock.forget()
        textblock.frugal()
        for batch in batches:
            for block in _blocks_of(batch.column("text")):
                own = list(elements(block, k))
                part = batch.slice(block.first, block.n_docs)
                parity = [_parity(u) for u in own]
                brief = [np.bitwise_xor.reduce(x.reshape(-1, BRIEF_WORDS), 0).tobytes() for x in parity]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(u) for u in own], pa.int32()), pa.array(parity, pa.list_(pa.int64())), pa.array(brief, pa.binary())], names=["node", "n", "parity", "brief"])

    return run


def exact_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The elements of each text as sorted numbers that agree within these texts, told apart by their words' bytes."""
    block = next(_blocks_of(texts, 1 << 62))
    codes, words = block.distinct()
    codes, size, base = codes.astype(np.int64), 1, max(1, len(words))
    m, many = max(0, len(codes) - k + 1), len(codes)
    grams = np.zeros(m, np.int64)
    for j in range(k):
        if size * base >= 1 << 62:
            found, grams = np.unique(grams, return_inverse=True)
            grams, size = grams.reshape(-1).astype(np.int64), max(1, len(found))
        grams, size = grams * base + codes[j : j + m], size * base
    short: dict[bytes, int] = {}
    out = []
    for a, b in zip(block.bounds.tolist(), block.bounds[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(codes[a:b].tobytes(), many + len(short))] if b > a else [], np.int64))
    return out


def _check(k: int, num: int, den: int):
    """Keeps the pairs that link, by their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textblock.forget()
        textblock.frugal()
        for batch in batches:
            sizes = np.asarray(batch.column("la")).astype(np.int64) + np.asarray(batch.column("lb"))
            for at, to in textblock.slices(np.concatenate([[0], np.cumsum(sizes)]), _CHUNK_BYTES):
                part = batch.slice(at, to - at)
                both = pa.concat_arrays([part.column("ta"), part.column("tb")]).dictionary_encode()
                sets, which = exact_sets(both.dictionary, k), np.asarray(both.indices)
                ok = []
                for x, y in zip(which[: to - at].tolist(), which[to - at :].tolist(), strict=True):
                    a, b = sets[x], sets[y]
                    shared_ = len(a) if x == y else len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(len(a) > 0 and den * shared_ >= num * (len(a) + len(b) - shared_))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def small(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A hint to broadcast a table of rows of fixed width, given only after counting it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _fits(a: str, b: str, plan: Plan) -> F.Column:
    """Whether two sizes allow a link."""
    return (F.col(a) * plan.den >= F.col(b) * plan.num) & (F.col(b) * plan.den >= F.col(a) * plan.num)


def _common(n: F.Column, plan: Plan) -> F.Column:
    """The least overlap of linked sets with ``n`` elements together."""
    return ((n.cast("long") * plan.num + (plan.num + plan.den - 1)) / (plan.num + plan.den)).cast("long")


class _Verifier:
    """Holds candidates against each other: first their sketches, then their texts."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, plan: Plan, work: shared.Work):
        wanted = docs.join(small(nodes), docs["doc_id"] == nodes["node"], "left_semi")
        self.nodes = work.written(wanted.mapInArrow(_sketched(k), "node long, n int, parity array<long>, brief binary"), "nodes")
        self.docs, self.k, self.plan, self.work = docs, k, plan, work

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        num, den = self.plan.num, self.plan.den
        brief = self.nodes.select("node", "n", "parity").hint("merge")
        rows = pairs.join(brief.toDF("a", "na", "pa"), "a").join(brief.toDF("b", "nb", "pb"), "b")
        differ = reduce(lambda x, y: x + y, [F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(PARITY_WORDS)])
        near = rows.where(differ * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b").distinct()
        near = self.work.written(near, "near")
        ends = self.work.written(near.select("a").union(near.select("b")).distinct(), "ends")
        texts = self.docs.join(small(ends), self.docs["doc_id"] == ends["a"], "left_semi").select("doc_id", "text", F.octet_length("text").alias("size")).hint("merge")
        both = near.join(texts.toDF("a", "ta", "la"), "a").join(texts.toDF("b", "tb", "lb"), "b")
        return self.work.written(both.mapInArrow(_check(self.k, num, den), "a long, b long").distinct(), "links")


def _chosen(rows: np.ndarray, other: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of the NEAREST pairs of each row."""
    order = np.lexsort((other, distance, rows))
    sorted_ = rows[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < NEAREST]


def _across(plan: Plan, nearest: bool):
    """Candidate pairs across the components of lists, by sizes, places in the lists and sketches."""

    def run(table: pa.Table) -> pa.Table:
        textblock.forget()
        textblock.frugal()
        key, low, high, own, node, n, place, component = (np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("key", "low", "high", "own", "node", "n", "place", "component"))
        brief = np.frombuffer(b"".join(table["brief"].to_pylist()), np.uint64).reshape(-1, BRIEF_WORDS)
        order = np.lexsort((component, high, low, key))
        key, low, high, own, node, n, place, component, brief = (x[order] for x in (key, low, high, own, node, n, place, component, brief))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        group = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(key))[group]
        run_ = np.flatnonzero(new | np.concatenate([[True], component[1:] != component[:-1]]))
        after = np.repeat(np.append(run_[1:], len(key)), np.diff(np.append(run_, len(key))))  # where the own component ends
        counts = np.maximum(ends - np.minimum(after, ends), 0)
        found: list[list[np.ndarray]] = [[], [], []]
        for at, to in textblock.slices(np.concatenate([[0], np.cumsum(counts)]), _CHUNK_PAIRS):
            c = counts[at:to]
            x = np.repeat(np.arange(at, to), c)
            y = np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + after[x]
            least = plan.common(n[x], n[y])
            ok = (n[x] - place[x] >= least) & (n[y] - place[y] >= least)
            ok &= (n[x] * plan.den >= n[y] * plan.num) & (n[y] * plan.den >= n[x] * plan.num) & (node[x] != node[y])
            ok &= (low[x] == high[x]) | (own[x] != own[y])
            x, y = x[ok], y[ok]
            differ = np.bitwise_count(brief[x] ^ brief[y]).sum(1, dtype=np.int64)
            ok = differ * (plan.den + plan.num) <= (n[x] + n[y]) * (plan.den - plan.num)
            x, y, differ = x[ok], y[ok], differ[ok]
            if nearest and len(x):  # so that what is kept grows with the sets, not with their pairs
                kept = np.unique(np.concatenate([_chosen(x, node[y], differ), _chosen(y, node[x], differ)]))
                x, y, differ = x[kept], y[kept], differ[kept]
            for out, value in zip(found, (x, y, differ), strict=True):
                out.append(value.astype(np.int32))
        x, y, differ = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in found)
        if nearest and len(x):
            kept = np.unique(np.concatenate([_chosen(x, node[y], differ), _chosen(y, node[x], differ)]))
            x, y = x[kept], y[kept]
        both = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), key[x]], 1), axis=0) if len(x) else np.zeros((0, 3), np.int64)
        return pa.table([pa.array(both[:, i]) for i in range(3)], names=["a", "b", "key"])

    return run


def _candidates(open_: DataFrame, rows: int, sketches: DataFrame, plan: Plan, nearest: bool) -> DataFrame:
    """Pairs (a, b) of the lists ``open_(key, node, n, place, component, g)``, by list. Long lists are met block by block."""
    many = F.ceil(F.col("g") / LIST_BLOCK).cast("int")
    own = open_.withColumn("many", many).withColumn("own", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = other.select("key", "node", "n", "place", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    bundle = F.pmod(F.xxhash64("key", "low", "high"), F.lit(max(1, math.ceil(rows / BUNDLE))))
    met = dealt.join(sketches.hint("merge"), "node").withColumn("bundle", bundle)
    return met.groupBy("bundle").applyInArrow(_across(plan, nearest), "a long, b long, key long")


def links(docs: DataFrame, signatures: DataFrame, k: int, plan: Plan, work: shared.Work) -> DataFrame:
    """Edges (a, b) between documents whose closure is that of all links between different texts."""
    # Of equal texts that several tasks have met, one enters the lists.
    made = signatures.where("firsts is not null").select("doc_id", "h")
    again = made.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    again = work.written(made.join(again, "h").where("doc_id > least").select("doc_id", "h"), "again")
    nodes = signatures.where("firsts is not null").join(small(again), ["doc_id", "h"], "left_anti")
    n = F.col("n")
    heavy = nodes.select(F.col("doc_id").alias("node"), "n", F.posexplode("firsts").alias("place", "key"))
    # In a pair the smaller set has its first common element among its first few, in view of the other's size.
    heavy = heavy.withColumn("early", F.col("place") <= n - _common(2 * n, plan))
    light = nodes.where("subsets is not null").select(F.col("doc_id").alias("node"), "n", F.explode(F.arrays_zip("subsets", "sizes")).alias("e"))
    light = light.select("node", "n", F.col("e.sizes").alias("s"), F.col("e.subsets").alias("key"))
    alive = heavy.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.bool_or("early").alias("early")).where("a < b and early").select("key")
    lists = work.written(heavy.drop("early").join(work.written(alive, "alive").hint("merge"), "key"), "lists")
    pivots = lists.groupBy("key").agg(F.min(F.struct("n", "node", "place")).alias("p"))
    star = lists.join(pivots.hint("merge"), "key").where("node <> p.node").select("node", "n", "place", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.place").alias("pplace"))
    least = _common(n + F.col("pn"), plan)
    star = star.where(_fits("n", "pn", plan) & (n - F.col("place") >= least) & (F.col("pn") - F.col("pplace") >= least)).select("node", "pivot")
    alive = light.groupBy("key").agg(F.min(F.struct("n", "node")).alias("p"), F.max("node").alias("b"), F.min("node").alias("a")).where("a < b")
    few = light.join(alive, "key").where((F.col("node") != F.col("p.node")) & (F.col("s") * plan.den >= plan.num * (F.col("p.n") + n - F.col("s"))))
    ends = lambda rows: rows.toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tried = work.written(ends(star.union(few.select("node", F.col("p.node")))), "pairs")
    wanted = lists.select("node").union(tried.select("a")).union(tried.select("b")).distinct()
    verifier = _Verifier(docs, work.written(wanted, "wanted"), k, plan, work)
    edges = verifier.links(tried)
    for turn in range(NEAREST_TURNS + 1):
        label = components(edges, work)
        marked = lists.select("key", "node", "n", "place").join(small(label), "node", "left").withColumn("component", F.coalesce("component", "node"))
        # The star has tried the only pair of a list of two.
        mixed = marked.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("g")).where("x < y and g > 2")
        lists = work.written(marked.join(work.written(mixed.select("key", "g"), "mixed").hint("merge"), "key"), "open")
        rows = lists.count()
        if not rows:
            break
        found = work.written(_candidates(lists, rows, verifier.nodes.select("node", "brief"), plan, turn < NEAREST_TURNS), "met")
        if found.isEmpty():
            break
        # Lists without candidates will have none later, as components only grow.
        lists = lists.drop("component", "g").join(work.written(found.select("key").distinct(), "keys").hint("merge"), "key")
        fresh = work.written(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(fresh)
        edges = work.written(edges.union(verifier.links(fresh)), "edges")
    return edges


def classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``."""
    spark = docs.sparkSession
    work = shared.Work(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    often, others = counted(docs, k)
    plan, frequent = planned(num, den, others), spark.sparkContext.broadcast(often)
    signatures = work.written(docs.mapInArrow(_signatures(k, plan, frequent), _SIGNATURES), "signatures")
    label = components(links(docs, signatures, k, plan, work), work).select(F.col("node").alias("doc_id"), "component")
    rows = signatures.select("doc_id", "n", "h")
    # Only some of equal texts are nodes, so the least id of a component may be that of a copy that is none.
    marked = rows.where("doc_id is not null and n > 0").join(small(label), "doc_id", "left")
    texts = marked.groupBy("h").agg(F.min("component").alias("c"), F.min("doc_id").alias("least"))
    whole = texts.where("c is not null").groupBy("c").agg(F.min("least").alias("whole"))
    least = texts.join(whole, "c", "left").select("h", F.coalesce("whole", "least").alias("text_component"))
    repeated = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if not repeated.isEmpty():
        out = _with_repeated_ids(rows, marked, least, work)
    else:
        own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("text_component")).otherwise(F.col("doc_id"))
        out = rows.join(least, "h", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
    out = shared.written(out, "classes")
    work.clear()
    frequent.unpersist()
    return out


def _with_repeated_ids(rows: DataFrame, marked: DataFrame, least: DataFrame, work: shared.Work) -> DataFrame:
    """Rows of one id are one document: what their texts reach is united."""
    tie = marked.join(least, "h").select(F.col("doc_id").alias("a"), F.col("text_component").alias("b"))
    label = components(tie, work).select(F.col("node").alias("doc_id"), "component")
    return rows.join(label, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the given ids."""
    return docs.join(small(ids.select(F.col(ids.columns[0]).alias(id_col))), id_col, "left_anti").select(docs.columns)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document (the smallest id) of each group of linked documents; columns as before.

    Documents without words and rows with a null id stay. Of several rows of one id that stays whose text is the least in
    order (a null text last); among rows with that text any.
    """
    found = classes(docs, k, num, den, id_col, text_col)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = without(docs, gone, id_col)
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    again = kept.join(twice.select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(docs.columns)
    text = F.col(text_col)
    one = again.groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.struct(text.isNull().alias("none"), text.alias("text"))).alias("r")).select("r.*")
    return without(kept, twice, id_col).union(one.select(docs.columns))
