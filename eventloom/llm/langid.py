"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs. A letter n-gram is bound by multiplying its letters' vectors, each
rotated once more than the next; a text is the bundle (sum) of its n-grams, scaled to length 1. A language prototype
bundles the texts of that language, and a text is given the language whose prototype has the largest cosine.

The letters are those of Unicode, lower-cased; anything between them counts as one gap. Letter vectors derive from the
code point alone, so no alphabet is fixed or shipped.

Prototypes are integer sums (components scaled by ``UNIT``), so they do not depend on the order of tasks or on retries.
Each task sums its own texts; one row for each task, language and component is shuffled.

Edge cases: null texts and texts without letters get ``und`` with score 0; ties go to the alphabetically first language;
texts with a null language take no part in learning; with nothing to learn from every text is ``und``. Texts are used
whole. Other columns pass through; ``lang_pred`` and ``score`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretoken, textblock

DIM = 1024
N = 3
UNIT = 1 << 20
UNKNOWN = "und"
SHORT = 24
#: A model holds 8 KB for each language; more languages than this are refused rather than sent to every task.
MAX_LANGUAGES = 4096
_GAP = 0x20
_DOCS = 256
_letters: dict[int, np.ndarray] = {}


def letter(point: int) -> np.ndarray:
    if point not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        bits = np.unpackbits(textblock.stream(point + 1, DIM // 64).view(np.uint8))
        _letters[point] = (bits.astype(np.int8) * 2 - 1).astype(np.int8)
    return _letters[point]


def bound(grams: np.ndarray) -> np.ndarray:
    """One row of signs for each n-gram (``N`` code points of 21 bits in a 64-bit number)."""
    out = np.ones((len(grams), DIM), np.int8)
    for j in range(N):
        points, which = np.unique((grams >> np.int64(21 * (N - 1 - j))) & 0x1FFFFF, return_inverse=True)
        if len(points):
            out *= np.stack([np.roll(letter(int(p)), N - 1 - j) for p in points])[which.reshape(-1)]
    return out.astype(np.float32)


def bundles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, unit vectors by document) for bounded runs of texts; zero rows for texts without letters."""
    for first, some in textblock.parts(texts, 8 << 20):
        for at, vectors in _bundles(some):
            yield first + at, vectors


def _bundles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    kinds = pretoken.classes()
    data, offsets = textblock.as_bytes(texts)
    for at, to in textblock.slices(offsets, 1 << 19):
        for first in range(at, to, _DOCS):
            last = min(to, first + _DOCS)
            pieces = [bytes(data[a:b]).decode("utf-8").lower().encode("utf-32-le") for a, b in zip(offsets[first:last].tolist(), offsets[first + 1 : last + 1].tolist(), strict=True)]
            lengths = np.array([len(p) // 4 for p in pieces]) + 2  # a gap before and after each text
            points = np.frombuffer(b"".join(b"\x20\0\0\0" + p + b"\x20\0\0\0" for p in pieces), np.uint32)
            doc = np.repeat(np.arange(last - first), lengths)
            is_letter = kinds[points] == pretoken.LETTER
            keep = is_letter.copy()
            keep[0] = True
            keep[1:] |= is_letter[:-1] & ~is_letter[1:]  # the first of a run of others
            symbols = np.where(is_letter, points, _GAP)[keep].astype(np.int64)
            doc = doc[keep]
            middle = np.flatnonzero(symbols[1:-1] != _GAP) + 1 if len(symbols) > 2 else np.zeros(0, np.int64)
            out = np.zeros((last - first, DIM), np.float32)
            if len(middle):
                grams = (symbols[middle - 1] << 42) | (symbols[middle] << 21) | symbols[middle + 1]
                found, which = np.unique(grams, return_inverse=True)
                counts = np.bincount(doc[middle] * len(found) + which.reshape(-1), minlength=len(out) * len(found))
                out = counts.reshape(len(out), len(found)).astype(np.float32) @ bound(found)
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            yield first, out


def _sums(text_col: str, lang_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textblock.forget()
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(lang_col).to_pylist()
            for first, vectors in bundles(batch.column(text_col)):
                fixed = np.rint(vectors * UNIT).astype(np.int64)
                own = np.array(langs[first : first + len(vectors)], object)
                for lang in {x for x in own if x is not None}:
                    total = fixed[own == lang].sum(0)
                    totals[lang] = totals[lang] + total if lang in totals else total
        if totals:
            names = sorted(totals)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, object), DIM), pa.string()), pa.array(np.tile(np.arange(DIM, dtype=np.int32), len(names))), pa.array(np.concatenate([totals[x] for x in names]))], names=["lang", "component", "total"])

    return run


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, their unit prototypes) from all rows with a language."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    sums = known.mapInArrow(_sums(text_col, lang_col), "lang string, component int, total long")
    rows = sums.groupBy("lang", "component").agg(F.sum("total").alias("total")).limit(MAX_LANGUAGES * DIM + 1).collect()
    if len(rows) > MAX_LANGUAGES * DIM:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted({r[0] for r in rows})
    place = {x: i for i, x in enumerate(names)}
    out = np.zeros((len(names), DIM))
    for lang, component, total in rows:
        out[place[lang], component] = total
    norms = np.linalg.norm(out, axis=1)
    names = [x for x, n in zip(names, norms, strict=True) if n > 0]
    return names, (out[norms > 0] / norms[norms > 0, None]).astype(np.float32)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """``carried`` (all columns, by default) with ``lang_pred`` and ``score``, the cosine cut to 0..1. No shuffle."""
    names, prototypes = model
    keep = [c for c in (df.columns if carried is None else carried) if c not in ("lang_pred", "score")]
    source = df.select(list(dict.fromkeys([*keep, text_col])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textblock.forget()
        for batch in batches:
            for first, vectors in bundles(batch.column(text_col)):
                part, some = batch.slice(first, len(vectors)), vectors.any(1)
                if names:
                    cosines = vectors @ prototypes.T
                    best = cosines.argmax(1)
                    langs = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
                    scores = np.where(some, np.clip(cosines.max(1), 0, 1), 0).astype(np.float64)
                else:
                    langs, scores = [UNKNOWN] * len(vectors), np.zeros(len(vectors))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    out = T.StructType([*[source.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, out)


def fold(id_col: str = "doc_id", folds: int = 4) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))


def held_out_prediction(docs: DataFrame, id_col: str = "doc_id", held: int = 2) -> DataFrame:
    """Learns from the other folds and predicts every document: id, held_out, lang_pred, score."""
    marked = docs.select(id_col, "text", "lang", (fold(id_col) == held).alias("held_out"))
    model = train(marked.where(~F.col("held_out")))
    return predict(marked, model, carried=[id_col, "held_out"])


def accepted(docs: DataFrame, least: float = 4 / DIM**0.5, least_short: float = 1 / DIM**0.5) -> DataFrame:
    """Documents in a learned language: not ``und``, and nearer to a prototype than random vectors are to any.

    Cosines of unrelated vectors have a deviation of ``1 / DIM**0.5``. Texts of fewer than ``SHORT`` letters hold too few
    trigrams to be near a prototype even in a learned language; they have a bound of their own, which half of the short
    texts in other scripts pass.
    """
    model = train(docs)
    found = predict(docs, model)
    short = F.length(F.regexp_replace("text", r"\P{L}+", "")) < SHORT
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= F.when(short, least_short).otherwise(least))).select(docs.columns)
