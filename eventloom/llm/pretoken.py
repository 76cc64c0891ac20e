"""Cutting texts into byte-BPE pre-tokens without a regular-expression engine.

The split is that of the pattern published with the rank files::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Read as rules on runs of one character class (letter, number, space, other):

* a run is one pre-token, and takes a single U+0020 that stands right before it;
* of a run of spaces before something else, all but the last form one pre-token; the last one joins what follows
  if it is U+0020, else it stands alone; at the end of a text the whole run is one pre-token;
* an apostrophe that begins its run, without a U+0020 before it, takes a following s, t, m, d, re, ve or ll.

Classes come from a table over all code points, filled from the ``regex`` library once a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textblock import Block, as_bytes, parts, slices

OTHER, LETTER, NUMBER, SPACE = range(4)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point."""
    global _classes
    if _classes is None:
        import regex

        out = np.zeros(0x110000, np.uint8)
        every = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")]).tobytes().decode("utf-32-le")
        for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                shift = [0x800 if i >= 0xD800 else 0 for i in (m.start(), m.end() - 1)]
                out[m.start() + shift[0] : m.end() + shift[1]] = code
        _classes = out
    return _classes


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the byte offset of each (with the total at the end)."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if len(at) == len(data):
        return data.astype(np.uint32), np.arange(len(data) + 1)
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.append(at, len(data))


def blocks(texts: pa.Array, limit: int = 1 << 21) -> Iterator[Block]:
    """One :class:`Block` for each bounded slice; its words are pre-tokens and cover every byte."""
    for first, some in parts(texts, 4 * limit):
        yield from _blocks(first, some, limit)


def _blocks(first_row: int, texts: pa.Array, limit: int) -> Iterator[Block]:
    data, offsets = as_bytes(texts)
    for at, to in slices(offsets, limit):
        part = data[offsets[at] : offsets[to]]
        cuts = offsets[at : to + 1] - offsets[at]
        if not len(part):
            yield Block(first_row + at, part, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(to - at + 1, np.int64))
            continue
        points, where = _points(part)
        kind, n = classes()[points], len(points)
        doc = np.zeros(n + 1, bool)
        doc[np.searchsorted(where, cuts)] = True
        doc[0] = doc[n] = True
        begin = doc.copy()
        begin[1:n] |= kind[1:] != kind[:-1]
        turns = np.flatnonzero(begin[:n] & ~doc[:n])  # where a class follows another one in a text
        after_space = turns[kind[turns - 1] == SPACE]
        begin[after_space - 1] = True  # the last space stands apart from its run
        joined = after_space[points[after_space - 1] == 0x20]
        begin[joined] = False
        quote = np.flatnonzero((points == 0x27) & begin[:n])
        if len(quote):
            follow = np.zeros((2, len(quote)), np.uint32)
            for j in (1, 2):
                ok = quote + j < n
                for k in range(1, j + 1):
                    ok &= ~doc[np.minimum(quote + k, n)]
                follow[j - 1, ok] = points[quote[ok] + j]
            one, two = follow
            short = np.isin(one, [ord(c) for c in "stmd"])
            pair = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for where_at, size in ((quote[short], 2), (quote[pair & ~short], 3)):
                begin[where_at + 1] = False
                begin[where_at + size] = True
        first = np.flatnonzero(begin)
        starts, ends = where[first[:-1]], where[first[1:]]
        yield Block(first_row + at, part, starts, ends, np.searchsorted(starts, cuts))
