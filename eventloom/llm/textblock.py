"""Vectorised splitting and hashing of text held in Arrow string arrays.

The corpus operators all start from the same step: cut the texts of a record batch into words without a
Python-level loop over characters or words. A :class:`Block` holds the UTF-8 bytes of a bounded slice of a
batch, the byte ranges of its words and the word ranges of its documents.

Null texts count as empty everywhere in this module. Slices are bounded by bytes, so memory does not grow with
the batch; one document is never cut, so the bound is exceeded only by a document longer than it.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_ROOT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_FACTORS = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes above which a range is hashed by BLAKE2b.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` reproducible pseudo-random 64-bit integers: the same on every executor and every retry."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ROOT)) ^ np.uint64(seed * 0xD1342543DE82EF95 & _MASK))


def _step(state: np.ndarray, value: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Takes 64 more bits into a state; not linear in either."""
    state = (state ^ value) * factor
    state ^= state >> np.uint64(32)
    return state


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every ``values[start:end]``, whatever stands around them.

    Up to LONG bytes are taken in eights into two chained states; longer ranges are hashed by BLAKE2b.
    """
    padded = np.concatenate([values, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(values) + 1,), np.dtype("<u8"), padded, strides=(1,))
    sizes = (ends - starts).astype(np.int64)
    a, b = np.full(len(starts), _ROOT, np.uint64), sizes.astype(np.uint64)
    todo, at, left = np.arange(len(starts)), starts.astype(np.int64), np.minimum(sizes, LONG)
    while len(todo):
        value = eights[at] & _KEEP[np.minimum(left, 8)]
        if len(todo) == len(a):
            a = _step(a, value, _FACTORS[0])
            b = _step(b, a, _FACTORS[1])
        else:
            a[todo] = _step(a[todo], value, _FACTORS[0])
            b[todo] = _step(b[todo], a[todo], _FACTORS[1])
        more = np.flatnonzero(left > 8)
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    out = mix(a ^ (b << np.uint64(23)) ^ (b >> np.uint64(41)))
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(values[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring values (``len - n + 1`` of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, seed * _ROOT & _MASK, np.uint64)
    for j in range(n):
        out = _step(out, hashes[j : j + m], _FACTORS[j & 1])
    return mix(out)


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges end to end, and their ``n + 1`` bounds."""
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(starts - bounds[:-1], sizes) + np.arange(int(bounds[-1]))], bounds


@dataclass
class Block:
    first: int  # index of its first document in the batch
    data: np.ndarray  # bytes
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    bounds: np.ndarray  # words of document i: bounds[i]:bounds[i + 1]

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """For each word the number of its distinct word, and those: equal by their bytes, not by a hash."""
        if len(self.starts) and (self.starts[1:] == self.ends[:-1]).all():
            data, bounds = self.data, np.append(self.starts, self.ends[-1])
        else:
            data, bounds = gathered(self.data, self.starts, self.ends)
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        found = pc.dictionary_encode(words)
        return np.asarray(found.indices), found.dictionary

    def docs_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, end to end, and the ``n + 1`` offsets of its values."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes stay under ``limit`` (or that hold one document)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def parts(texts: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    """(first value, values) of runs of about ``limit`` bytes, so that only a run is copied at a time."""
    step = max(1, int(len(texts) * limit / max(1, texts.nbytes)))
    for at in range(0, len(texts), step):
        yield at, texts.slice(at, step)
        pa.default_memory_pool().release_unused()
        _release(0)


try:  # what numpy has freed goes back to the system between batches, where the C library can do that
    _release = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):
    _release = int


_kept: dict = {}


def kept(key: tuple, make):
    """What ``make`` gives, kept between a worker's tasks under ``key``, whose first part names the operator."""
    forget(key[0])
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget(but: str | None = None) -> None:
    """Drops what other operators have kept: a worker goes from stage to stage, and what it remembers would add up."""
    gone = [key for key in _kept if key[0] != but]
    for key in gone:
        del _kept[key]
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
        _release(0)


def frugal() -> None:
    """Lets what this worker frees go back to the system at once: large buffers, Arrow's too, are mapped one by one.

    For workers that later run other stages beside a full heap; it costs some time in the kernel.
    """
    try:
        ctypes.CDLL(None).mallopt(_MMAP_THRESHOLD, 1 << 18)
        pa.set_memory_pool(pa.system_memory_pool())
    except (OSError, AttributeError):
        return


_MMAP_THRESHOLD = -3  # fixed value: the option's number in the C library


def word_table(separators: bytes) -> np.ndarray:
    """A 256-entry table: true where a byte belongs to a word. Bytes of non-ASCII characters always do."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def blocks(texts: pa.Array, table: np.ndarray, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Block]:
    """Cuts texts into maximal runs of word bytes; ``lower`` folds A-Z only."""
    for first, some in parts(texts, 8 * limit):
        yield from _blocks(first, some, table, lower, limit)


def _blocks(first: int, texts: pa.Array, table: np.ndarray, lower: bool, limit: int) -> Iterator[Block]:
    data, offsets = as_bytes(texts)
    for at, to in slices(offsets, limit):
        part = data[offsets[at] : offsets[to]]
        part = _LOWER[part] if lower else part
        cuts = offsets[at : to + 1] - offsets[at]
        inside = table[part]
        begin, close = inside.copy(), inside.copy()
        if len(part):
            begin[1:] &= ~inside[:-1]
            close[:-1] &= ~inside[1:]
            edge = cuts[(cuts > 0) & (cuts < len(part))]  # a word never spans two documents
            begin[edge] = inside[edge]
            close[edge - 1] = inside[edge - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
        yield Block(first + at, part, starts, ends, np.searchsorted(starts, cuts))
