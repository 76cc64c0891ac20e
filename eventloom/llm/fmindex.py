"""A compressed full-text index over short word sequences, in numpy.

The sequences stand end to end, each with a terminator of its own (smaller than every word, in the order of the
sequences), so suffixes never compare beyond their sequence. The Burrows-Wheeler transform is kept as a wavelet matrix:
one packed bit vector for each bit of the word numbers, with a count for each 64 bits. Neither the text nor the suffix
array is kept, only the owner of each suffix, as minima over runs of powers of two. Backward search runs for all patterns
at once.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """Rank of any symbol in a sequence of numbers below ``size``."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(size - 1).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bit = (values >> level) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.start = self._descend(np.arange(size), np.zeros(size, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(at)
            at = np.where((symbols >> (self.depth - 1 - i)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbols, at) - self.start[symbols]


class FMIndex:
    def __init__(self, words: np.ndarray, lengths: np.ndarray, owners: np.ndarray):
        """``words``: numbers from 0, the sequences end to end; ``lengths``: words of each sequence; ``owners``: a number
        for each sequence."""
        n, self.size = len(lengths), int(words.max()) + 1 if len(words) else 1
        starts = np.cumsum(lengths) - lengths + np.arange(n)
        text = np.full(len(words) + n, -1, np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(n), lengths)] = words
        rank = text + n
        rank[starts + lengths] = np.arange(n)
        step = 1
        while True:  # prefix doubling: order by the first 2, 4, 8, ... symbols
            after = np.zeros(len(rank), np.int64)
            after[:-step] = rank[step:]
            _, rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)
            rank = rank.reshape(-1)
            if len(rank) == 0 or rank.max() == len(rank) - 1:
                break
            step *= 2
        order = np.argsort(rank)  # the suffix array
        self.length = len(order)
        self.transform = Wavelet(text[order - 1] + 1, self.size + 1)
        self.first = n + np.concatenate([[0], np.cumsum(np.bincount(words, minlength=self.size))])
        self.minima = [np.asarray(owners)[np.searchsorted(starts, order, side="right") - 1]]
        while 2 << (len(self.minima) - 1) <= len(order):
            half, low = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(low[:-half], low[half:]))

    def extend(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix-array intervals of the patterns with one more word on their left."""
        return self.first[words] + self.transform.rank(words + 1, low), self.first[words] + self.transform.rank(words + 1, high)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner in each (not empty) interval."""
        out = np.zeros(len(low), self.minima[0].dtype)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out

    def statistics(self, words: np.ndarray, lengths: np.ndarray, owners: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed sequences: (sequence, last word, words of the longest match that ends there).

        A match stands in a sequence with a smaller owner. Only matches of at least ``least`` words are given.
        """
        starts = np.cumsum(lengths) - lengths
        counts = np.maximum(lengths - least + 1, 0)
        which = np.repeat(np.arange(len(lengths)), counts)
        last = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + least - 1
        out, todo = np.zeros(len(which), np.int64), np.arange(len(which))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.length, np.int64)
        matched = 0
        while len(todo):
            c = words[starts[which[todo]] + last[todo] - matched]
            known = c < self.size
            todo, low, high, c = todo[known], low[known], high[known], c[known]
            low, high = self.extend(c, low, high)
            matched += 1
            ok = high > low
            if matched >= least:
                ok[ok] = self.least(low[ok], high[ok]) < owners[which[todo[ok]]]
                out[todo[ok]] = matched
            ok &= last[todo] >= matched
            todo, low, high = todo[ok], low[ok], high[ok]
        found = np.flatnonzero(out)
        return which[found], last[found], out[found]
