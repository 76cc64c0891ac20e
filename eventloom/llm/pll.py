"""Language-model scores by masked pseudo-likelihood.

A small network predicts every token from ``SIDE`` tokens on each side: their embeddings pass a hidden layer, and a
two-level softmax (class, then member) gives an exactly normalised probability over the ``WORDS`` most frequent words,
``ENDINGS`` groups of other known words (by a hash of their last three bytes), and one token for all that is spelled.

* A known word has its group's probability times its own share of the group's occurrences in the corpus.
* A word counted fewer than ``LEAST`` times is spelled: its probability is that of the token times that of its bytes, each
  given the one before, from counts of the corpus. So every word has a probability of its own, and all of them sum to 1.
  At most ``TABLE_WORDS`` words are known, which bounds what a task holds; the rarest of more are spelled as well.

A document's score is the sum of the conditional log-probabilities of its tokens.

1. The words of all documents are counted (a grouped sum over all distinct words), and so are the pairs of bytes in them.
2. The network is trained in ``ROUNDS`` over disjoint parts of the documents that cover all of them, each larger than the
   last. In a round the documents are dealt to shards of about ``SHARD_DOCS`` by a hash of id and text, every shard trains
   from the same network, and the results are averaged, weighted by their windows, in integer sums. Neither the number of
   input files nor the order of tasks changes a score.
3. Every document is scored; nothing but ids and scores leaves the tasks.

Edge cases: null and empty texts, and texts without words, have 0 tokens, score 0 and a null mean; beyond a text's ends
the window holds a padding token; documents are whole, whatever their length; repeated rows and ties give equal scores;
null ids are kept; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textblock
from .leaks import SEPARATORS

SIDE = 2
CLASSES = MEMBERS = 32
ENDINGS = 127
SPELLED = CLASSES * MEMBERS - 1
WORDS = SPELLED - ENDINGS
PADDING = CLASSES * MEMBERS
#: Words of fewer occurrences in the corpus are spelled.
LEAST = 2
TABLE_WORDS = 2_000_000
EMBED, HIDDEN = 12, 16
BATCH = 8192
SHARD_DOCS = 4000
#: Sixteenths of the documents in each round, and its rate.
ROUNDS = [(1, 0.02), (1, 0.02), (2, 0.01), (4, 0.006), (8, 0.004)]
UNIT = 1 << 20
_CHUNK = 4096
_ENDING_BITS = np.uint64(127)
_SIZES = {"embed": (CLASSES * MEMBERS + 1, EMBED), "inner": (2 * SIDE * EMBED, HIDDEN), "bias": (HIDDEN,), "classes": (CLASSES, HIDDEN), "class_bias": (CLASSES,), "members": (CLASSES, MEMBERS, HIDDEN), "member_bias": (CLASSES, MEMBERS)}
PARAMETERS = sum(int(np.prod(s)) for s in _SIZES.values())


def _blocks(texts: pa.Array):
    return textblock.blocks(texts, textblock.word_table(SEPARATORS), lower=True)


def _keys(block: textblock.Block) -> np.ndarray:
    """A hash of each word of a block, whose lowest bits are the word's ending."""
    ending = textblock.range_hashes(block.data, np.maximum(block.starts, block.ends - 3), block.ends)
    return (block.hashes() & ~_ENDING_BITS) | (ending % np.uint64(ENDINGS))


def _steps(block: textblock.Block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous and next byte, as one number, of every step in spelling the words, end to end; their bounds).

    Bytes count from 1; 0 stands before the first byte and after the last.
    """
    data, bounds = textblock.gathered(block.data, block.starts[words], block.ends[words])
    sizes = np.diff(bounds) + 1
    edges = np.concatenate([[0], np.cumsum(sizes)])
    after = np.zeros(int(edges[-1]), np.int64)
    after[np.arange(len(data)) + np.repeat(np.arange(len(words)), sizes - 1)] = data.astype(np.int64) + 1
    before = np.zeros(len(after), np.int64)
    before[1:] = after[:-1]
    return before * 257 + after, edges


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): kind 0 for words, 1 for steps of spelling."""
    kept, sums, fresh, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    steps = np.zeros(257 * 257, np.int64)

    def merged():
        values = np.concatenate([kept, *fresh])
        weights = np.concatenate([sums, np.ones(len(values) - len(kept), np.int64)])
        found, which = np.unique(values, return_inverse=True)
        return found, np.bincount(which, weights, len(found)).astype(np.int64)

    def rows(kind: int, keys: np.ndarray, n: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "word", "n"])

    for batch in batches:
        for block in _blocks(batch.column("text")):
            fresh.append(_keys(block))
            size += len(fresh[-1])
            steps += np.bincount(_steps(block, np.arange(len(block.starts)))[0], minlength=len(steps))
            if size > 1_000_000:
                (kept, sums), fresh, size = merged(), [], 0
                if len(kept) > 2_000_000:  # bounds the task's memory; the grouped sum adds the parts up
                    yield rows(0, kept.view(np.int64), sums)
                    kept, sums = kept[:0], sums[:0]
    kept, sums = merged()
    yield rows(0, kept.view(np.int64), sums)
    met = np.flatnonzero(steps)
    yield rows(1, met, steps[met])


@dataclass
class Model:
    words: np.ndarray  # keys: the most frequent words, then the other known ones
    share: np.ndarray  # of the other known words: the logarithm of the share in their group
    spelling: np.ndarray  # the logarithm of each step's probability
    flat: np.ndarray  # the network


def vocabulary(docs: DataFrame) -> Model:
    """The known words, their shares and the spelling, with an untrained network."""
    work = shared.Work(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_counts, "kind int, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    counted = work.written(counted, "words")
    column = lambda t, c: np.asarray(t[c].combine_chunks())
    words = counted.where("kind = 0")
    by_count = words.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect()  # at most 1,000 rows
    least, total = 1001, 0
    for n, c in by_count:
        total += c
        if n < LEAST or total > TABLE_WORDS:
            break
        least = n
    top = words.orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    rows = words.where(F.col("n") >= least).toArrow()
    head, keys, n = column(top, "word"), column(rows, "word"), column(rows, "n")
    left = ~np.isin(keys, head)
    keys, n = keys[left], n[left]
    order = np.lexsort((keys, -n))
    keys, n = keys[order], n[order]
    group = keys & int(_ENDING_BITS)
    share = np.log(n / np.bincount(group, n, ENDINGS)[group]) if len(n) else np.zeros(0)
    steps = counted.where("kind = 1").toArrow()  # at most 257 * 257 rows
    seen = np.ones(257 * 257)
    seen[column(steps, "word")] += column(steps, "n")
    seen = seen.reshape(257, 257)
    work.clear()
    return Model(np.concatenate([head, keys]).view(np.uint64), share, np.log(seen / seen.sum(1, keepdims=True)).reshape(-1), start())


class Vocabulary:
    """Places of words among the known ones."""

    def __init__(self, words: np.ndarray):
        bits = max(4, int(2 * len(words)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.words, self.table = words, np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(words)), self._slots(words)
        while len(todo):  # open addressing; of those that meet in a free slot, one stays
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            away = self.table[at] != todo
            todo, at = todo[away], (at[away] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the words, or -1."""
        if not len(self.words):
            return np.full(len(keys), -1, np.int64)
        at = self._slots(keys)
        out = self.table[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.words[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.table[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.words[out[todo]] != keys[todo])]
        return out

    def windows(self, block: textblock.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, the tokens around it, the word's place or -1) for each word of a block."""
        keys = _keys(block)
        found = self.places(keys)
        group = WORDS + (keys & _ENDING_BITS).astype(np.int64)
        near = np.where((found >= 0) & (found < WORDS), found, group)  # spelled words are known by their endings
        tokens = np.where(found < 0, SPELLED, near)
        at = np.arange(len(tokens)) + SIDE * (1 + block.docs_of_words())
        padded = np.full(len(tokens) + SIDE * (block.n_docs + 1), PADDING, np.int64)
        padded[at] = near
        around = [padded[at + j] for j in range(-SIDE, SIDE + 1) if j]
        return tokens, np.stack(around, 1) if len(tokens) else np.zeros((0, 2 * SIDE), np.int64), found


def within(block: textblock.Block, tokens: np.ndarray, places: np.ndarray, model: Model) -> np.ndarray:
    """The logarithm of each word's probability given its token."""
    out = np.zeros(len(tokens))
    known = np.flatnonzero(places >= WORDS)
    out[known] = model.share[places[known] - WORDS]
    spelled = np.flatnonzero(tokens == SPELLED)
    if len(spelled):
        steps, edges = _steps(block, spelled)
        out[spelled] = np.add.reduceat(model.spelling[steps], edges[:-1])
    return out


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SIZES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def start(seed: int = 5) -> np.ndarray:
    random = np.random.default_rng(seed)
    flat = (random.standard_normal(PARAMETERS) * 0.2).astype(np.float32)
    parts = unpack(flat)
    for name in ("bias", "class_bias", "member_bias"):
        parts[name][:] = 0
    return flat


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    logits -= logits.max(1, keepdims=True)
    e = np.exp(logits)
    total = e.sum(1, keepdims=True)
    e /= total
    logits -= np.log(total)
    return logits, e


class Network:
    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        self.p = unpack(self.flat)

    def run(self, tokens: np.ndarray, around: np.ndarray, gradient: bool = False):
        """Log-probabilities of the tokens; with ``gradient`` also the flat gradient of their sum."""
        p, n = self.p, len(tokens)
        order = np.argsort(tokens)
        x = p["embed"][around[order]].reshape(n, -1)
        tokens = tokens[order]
        group, member = tokens // MEMBERS, tokens % MEMBERS
        hidden = np.tanh(x @ p["inner"] + p["bias"])
        log_class, class_p = _softmax(hidden @ p["classes"].T + p["class_bias"])
        rows = np.arange(n)
        out = log_class[rows, group]
        edges = np.searchsorted(group, np.arange(CLASSES + 1))
        back = None
        if gradient:
            flat = np.zeros(PARAMETERS, np.float32)
            g = unpack(flat)
            class_p *= -1
            class_p[rows, group] += 1
            g["classes"][:] = class_p.T @ hidden
            g["class_bias"][:] = class_p.sum(0)
            back = class_p @ p["classes"]
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a == b:
                continue
            log_member, member_p = _softmax(hidden[a:b] @ p["members"][c].T + p["member_bias"][c])
            own = rows[: b - a]
            out[a:b] += log_member[own, member[a:b]]
            if gradient:
                member_p *= -1
                member_p[own, member[a:b]] += 1
                g["members"][c] = member_p.T @ hidden[a:b]
                g["member_bias"][c] = member_p.sum(0)
                back[a:b] += member_p @ p["members"][c]
        scores = np.empty(n, np.float32)
        scores[order] = out
        if not gradient:
            return scores
        back *= 1 - hidden * hidden
        g["inner"][:] = x.T @ back
        g["bias"][:] = back.sum(0)
        slope = (back @ p["inner"].T).reshape(-1)
        at = (around[order].reshape(-1, 1) * EMBED + np.arange(EMBED)).reshape(-1)
        g["embed"][:] = np.bincount(at, slope, g["embed"].size).reshape(g["embed"].shape)
        return scores, flat


class Trainer:
    """Gradient steps over batches of windows, scaled by a running mean of squares."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.network, self.rate, self.squares, self.steps, self.windows = Network(flat), rate, np.zeros(PARAMETERS, np.float32), 0, 0

    def feed(self, tokens: np.ndarray, around: np.ndarray) -> None:
        for at in range(0, len(tokens), BATCH):
            part = tokens[at : at + BATCH]
            _, slope = self.network.run(part, around[at : at + BATCH], gradient=True)
            slope /= len(part)
            self.steps += 1
            self.squares += 0.01 * (slope * slope - self.squares)
            rate = self.rate / (1 + self.steps / 200) ** 0.5
            self.network.flat += rate * slope / (np.sqrt(self.squares / (1 - 0.99**self.steps)) + 1e-5)
            self.windows += len(part)


_ROWS = "chunk int, n long, part binary"


def _train(model, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, lookup = Trainer(model.value.flat, rate), Vocabulary(model.value.words)
        for batch in batches:
            for block in _blocks(batch.column("text")):
                trainer.feed(*lookup.windows(block)[:2])
        if trainer.windows:
            parts = [trainer.network.flat[a : a + _CHUNK].tobytes() for a in range(0, PARAMETERS, _CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([trainer.windows] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "n", "part"])

    return run


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, n, part in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "part")), strict=True):
            values = np.frombuffer(part, np.float32)
            high, low, total = sums.setdefault(chunk, np.zeros((3, len(values)), np.int64))
            fixed = np.rint(np.clip(values.astype(np.float64), -1000, 1000) * UNIT).astype(np.int64)
            high += fixed * (n >> 20)  # two limbs, so that no sum overflows
            low += fixed * (n & (1 << 20) - 1)
            total += n
    for chunk, (high, low, total) in sums.items():
        mean = (high.astype(np.float64) * (1 << 20) + low) / total / UNIT
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([int(total[0])], pa.int64()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["chunk", "n", "part"])


def _averaged(rows: DataFrame, otherwise: np.ndarray) -> np.ndarray:
    """The averaged network; the given one if no shard had a window."""
    out = otherwise.copy()
    for batch in rows.repartition("chunk").mapInArrow(_means, _ROWS).toArrow().to_batches():
        for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part").to_pylist(), strict=True):
            values = np.frombuffer(part, np.float32)
            out[chunk * _CHUNK : chunk * _CHUNK + len(values)] = values
    return out


def train(docs: DataFrame) -> Model:
    """A model of all documents ``(doc_id, text)``."""
    known = docs.where("text is not null").select("doc_id", "text")
    model, n = vocabulary(known), known.count()
    hashed = known.select("text", F.xxhash64("doc_id", "text").alias("h"))
    parts, first = sum(size for size, _ in ROUNDS), 0
    for size, rate in ROUNDS:
        own = hashed.where(F.pmod(F.shiftrightunsigned("h", 32), F.lit(parts)).between(first, first + size - 1))
        shards = max(1, math.ceil(n * size / parts / SHARD_DOCS))
        sent = docs.sparkSession.sparkContext.broadcast(model)
        trained = own.repartition(shards, "h").sortWithinPartitions("h", "text").mapInArrow(_train(sent, rate), _ROWS)
        model = Model(model.words, model.share, model.spelling, _averaged(trained, model.flat))
        sent.unpersist()
        first += size
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, network = Vocabulary(model.value.words), Network(model.value.flat)
        for batch in batches:
            for block in _blocks(batch.column("text")):
                tokens, around, places = lookup.windows(block)
                parts = [network.run(tokens[a : a + BATCH], around[a : a + BATCH]) for a in range(0, len(tokens), BATCH)]
                own = np.concatenate(parts).astype(np.float64) + within(block, tokens, places, model.value) if parts else np.zeros(0)
                count = np.diff(block.bounds)
                total = np.bincount(block.docs_of_words(), own, block.n_docs).astype(np.float64)
                mean = pa.array(total / np.maximum(count, 1), mask=count == 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.n_docs), pa.array(count, pa.int64()), pa.array(total), mean], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return run


def scores(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood; trains on ``docs`` unless a model is given."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared_model = docs.sparkSession.sparkContext.broadcast(model or train(slim))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_score(shared_model), f"doc_id {kind}, n_tokens long, log_likelihood double, mean_log_likelihood double")
