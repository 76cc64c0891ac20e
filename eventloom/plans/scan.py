"""Scan mode: a matcher tree as one boolean Column over the event table.

Positive leaves are plain comparisons, so they reach the Parquet scan. Under a negation leaves are two-valued: an event
without the field does not match the leaf, hence matches its negation.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import labels, tokens
from ..types import FieldType
from .ast import All, AnyOf, Between, Every, Nothing, Phrase, Term, Without


def literal(value) -> Column:
    if isinstance(value, datetime):
        return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")
    return F.lit(value)


def _words(kind: FieldType, column: Column) -> Column:
    return tokens(column) if kind is FieldType.TEXT else labels(column)


def phrase(words: Column, column: Column, terms: tuple) -> Column:
    """Terms at consecutive places; places at the edges that may hold anything need not exist."""
    inner = list(terms)
    while inner and inner[0] is None:
        inner.pop(0)
    while inner and inner[-1] is None:
        inner.pop()
    if not inner:
        return column.isNotNull()
    known = [t for t in inner if t is not None]
    # Cheap and necessary: spares cutting most texts into words.
    guard = F.lower(column).contains(max(known, key=len))
    if len(inner) == 1:
        return guard & F.array_contains(words, inner[0])
    if None not in inner:
        return guard & F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {' '.join(inner)} ")

    def somewhere(known_words: Column) -> Column:
        def at(i: Column) -> Column:
            checks = [F.get(known_words, i + k) == t for k, t in enumerate(inner) if t is not None]
            out = checks[0]
            for c in checks[1:]:
                out = out & c
            return out

        last = F.size(known_words) - len(inner)
        return F.exists(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), at)

    # The words are bound to a variable: inside the test of a place they would be cut out of the text again for each.
    return guard & F.exists(F.array(words), somewhere)


def column(node, field) -> Column:
    """``field``: FieldId to the Column bound to it."""
    if isinstance(node, Every):
        return F.lit(True)
    if isinstance(node, Nothing):
        return F.lit(False)
    if isinstance(node, Term):
        c = field(node.field)
        if node.field.type in (FieldType.TEXT, FieldType.HOSTNAME):
            return phrase(_words(node.field.type, c), c, (node.term,))
        return c == literal(node.term)
    if isinstance(node, Phrase):
        c = field(node.field)
        return phrase(_words(node.field.type, c), c, node.terms)
    if isinstance(node, Between):
        c, parts = field(node.field), []
        if node.low is not None:
            parts.append(c > literal(node.low) if node.low_open else c >= literal(node.low))
        if node.high is not None:
            parts.append(c < literal(node.high) if node.high_open else c <= literal(node.high))
        return parts[0] if len(parts) == 1 else parts[0] & parts[1]
    if isinstance(node, Without):
        drop = ~F.coalesce(column(node.filter, field), F.lit(False))
        return drop if isinstance(node.source, Every) else column(node.source, field) & drop
    parts = [column(c, field) for c in node.children]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(node, All) else out | p
    return out
