"""Inverted and forward index tables.

``postings``: one row for each event, field and term: ``field, event_id, positions`` and the term in the column of its
physical type. Text has a term for each word, hostnames for each label, both with positions; other types one term.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import bound, labels, tokens
from ..types import FieldId, FieldType

TERM_COLUMNS = {k: {"integer": "term_long", "float": "term_double", "datetime": "term_time", "address": "term_bytes"}.get(k.value, "term") for k in FieldType}
_TYPES = {"term": T.StringType(), "term_long": T.LongType(), "term_double": T.DoubleType(), "term_time": T.TimestampNTZType(), "term_bytes": T.BinaryType()}


def _words(kind: FieldType, value: Column) -> Column:
    return tokens(value) if kind is FieldType.TEXT else labels(value)


def _grouped(spots: Column) -> Column:
    """``array<struct<term, positions>>`` of sorted (term, at)."""
    at = lambda i: F.get(spots, i)
    firsts = F.filter(F.sequence(F.lit(0), F.size(spots) - 1), lambda i: (i == 0) | (at(i)["term"] != at(i - 1)["term"]))

    def cut(firsts: Column) -> Column:
        ends = lambda k: F.coalesce(F.get(firsts, k + 1), F.size(spots)) - 1
        return F.transform(firsts, lambda i, k: F.struct(at(i)["term"].alias("term"), F.transform(F.sequence(i, ends(k)), lambda j: at(j)["at"]).alias("positions")))

    return F.when(F.size(spots) > 0, bound(firsts, cut))


def of_field(events: DataFrame, field: FieldId, value: Column) -> DataFrame:
    """The postings of one field. Texts are dealt by event, each once; the words of an event are then grouped by array
    functions, so that no word is shuffled."""
    own = TERM_COLUMNS[field.type]
    if field.type in (FieldType.TEXT, FieldType.HOSTNAME):
        texts = events.select("event_id", value.alias("__text")).where("__text is not null").repartition("event_id")
        spots = lambda text: F.transform(_words(field.type, text), lambda t, i: F.struct(t.alias("term"), i.alias("at")))
        whole = texts.groupBy("event_id").agg(F.collect_list("__text").alias("__texts"))
        rows = whole.select("event_id", F.explode(bound(F.sort_array(F.flatten(F.transform("__texts", spots))), _grouped)).alias("x")).select("event_id", "x.term", "x.positions")
    else:
        rows = events.select("event_id", value.alias(own), F.lit(None).cast("array<int>").alias("positions")).where(F.col(own).isNotNull())
    others = [F.lit(None).cast(t).alias(c) for c, t in _TYPES.items() if c != own]
    rows = rows.select(F.lit(str(field)).alias("field"), "event_id", own, *others, "positions")
    return rows.select("field", *_TYPES, "event_id", "positions")


def build(events: DataFrame, fields: dict[FieldId, Column]) -> DataFrame:
    """Postings of all given fields; ``events`` has ``event_id``."""
    return reduce(lambda a, b: a.unionByName(b), [of_field(events, f, c) for f, c in fields.items()])


def write(postings: DataFrame, path: str, partitions: int | None = None, mode: str = "append") -> None:
    """Sorted by field and term, so that a term's rows sit in few row groups and the others are skipped by min/max."""
    keys = ["field", *_TYPES]
    dealt = postings.repartitionByRange(*([partitions] if partitions else []), *keys)
    dealt.sortWithinPartitions(*keys, "event_id").write.mode(mode).option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def forward(postings: DataFrame) -> DataFrame:
    """The index by event: event_id, field and its terms."""
    return postings.groupBy("event_id", "field").agg(F.sort_array(F.collect_set(term_text())).alias("terms"))


def term_text() -> Column:
    """The term of a posting as text, whatever its type."""
    return F.coalesce("term", F.col("term_long").cast("string"), F.col("term_double").cast("string"), F.col("term_time").cast("string"), F.hex("term_bytes"))


def text_of(term) -> str:
    """The same of a term in a query."""
    if isinstance(term, bytes):
        return term.hex().upper()
    if isinstance(term, datetime):
        return term.isoformat(" ").rstrip("0").rstrip(".") if term.microsecond else term.isoformat(" ")
    return str(term)
