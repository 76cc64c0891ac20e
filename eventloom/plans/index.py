"""Index mode: a matcher tree as semi and anti joins of postings.

Only the postings of the query's terms are read (the table is sorted by field and term), and each step keeps event ids
only. Conjunctions start at the rarest child if statistics are given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.postings import TERM_COLUMNS
from ..types import FieldId
from .ast import All, AnyOf, Between, Every, Nothing, Phrase, Term, Without
from .scan import literal


def _rows(postings: DataFrame, field: FieldId) -> DataFrame:
    return postings.where(F.col("field") == str(field))


def _term(postings: DataFrame, field: FieldId, term) -> DataFrame:
    return _rows(postings, field).where(F.col(TERM_COLUMNS[field.type]) == literal(term))


def ids(node, postings: DataFrame, events: DataFrame, stats=None) -> DataFrame:
    """Distinct ``event_id`` of the matching events."""
    if isinstance(node, Every):
        return events.select("event_id").distinct()
    if isinstance(node, Nothing):
        return events.select("event_id").limit(0)
    if isinstance(node, Term):
        return _term(postings, node.field, node.term).select("event_id")
    if isinstance(node, Between):
        c, rows = F.col(TERM_COLUMNS[node.field.type]), _rows(postings, node.field)
        if node.low is not None:
            rows = rows.where(c > literal(node.low) if node.low_open else c >= literal(node.low))
        if node.high is not None:
            rows = rows.where(c < literal(node.high) if node.high_open else c <= literal(node.high))
        return rows.select("event_id")
    if isinstance(node, Phrase):
        return _phrase(node, postings, stats)
    if isinstance(node, All):
        return reduce(lambda a, b: a.join(b, "event_id", "left_semi"), [ids(c, postings, events, stats) for c in node.children])
    if isinstance(node, AnyOf):
        return reduce(lambda a, b: a.union(b), [ids(c, postings, events, stats) for c in node.children]).distinct()
    assert isinstance(node, Without)
    return ids(node.source, postings, events, stats).join(ids(node.filter, postings, events, stats), "event_id", "left_anti")


def _phrase(node: Phrase, postings: DataFrame, stats) -> DataFrame:
    """One row for each event and term, joined on the event; positions are compared as arrays."""
    places = [(k, t) for k, t in enumerate(node.terms) if t is not None]
    if not places:
        return _rows(postings, node.field).select("event_id").distinct()
    different = sorted({t for _, t in places}, key=lambda t: (stats(node.field, t) if stats else 0, t))
    name = {t: f"p{i}" for i, t in enumerate(different)}
    rows = [_term(postings, node.field, t).select("event_id", F.col("positions").alias(name[t])) for t in different]
    joined = reduce(lambda a, b: a.join(b, "event_id"), rows)
    seed = next((k, t) for k, t in places if t == different[0])

    def fits(p):
        checks = [F.array_contains(F.col(name[t]), (p + (k - seed[0])).cast("int")) for k, t in places if (k, t) != seed]
        return reduce(lambda a, b: a & b, checks, F.lit(True))

    return joined.where(F.exists(name[seed[1]], fits)).select("event_id")
