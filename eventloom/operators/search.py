"""From a query string to ordered, limited, projected events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Binding
from ..functions.query import Clock, system_clock
from ..functions.values import host_key
from ..plans import index, scan
from ..plans.ast import All, AnyOf, Between, Phrase, Term, Without
from ..plans.language import parse_query
from ..plans.matchers import explain, order, plan, prune
from ..types import FieldId, FieldType
from .postings import text_of

#: Ranges that rows are numbered in (a power of two), and rows drawn for each border.
_RANGES, _DRAWN = 256, 16


def matcher(query: str, binding: Binding, default_field: str = "message", clock: Clock = system_clock):
    """The planned query of a string over a binding."""
    return prune(plan(parse_query(query, clock), default_field), binding.knows)


def leaves(node):
    if isinstance(node, Term | Phrase | Between):
        yield node
    elif isinstance(node, All | AnyOf):
        for c in node.children:
            yield from leaves(c)
    elif isinstance(node, Without):
        yield from leaves(node.source)
        yield from leaves(node.filter)


def needed(node) -> list[tuple[str, str | None]]:
    """The (field, term) pairs whose frequencies an estimate wants."""
    out = []
    for leaf in leaves(node):
        if isinstance(leaf, Between):
            out.append((str(leaf.field), None))
        else:
            terms = [leaf.term] if isinstance(leaf, Term) else [t for t in leaf.terms if t is not None]
            out += [(str(leaf.field), text_of(t)) for t in terms] or [(str(leaf.field), None)]
    return out


def sort_key(field: FieldId, column: Column) -> Column:
    return host_key(column) if field.type is FieldType.HOSTNAME else column


def ordering(keys: Sequence[tuple[FieldId, Column]], tie: Column, descending: bool) -> list[Column]:
    """Missing values come first ascending and last descending; equal keys are ordered by the event id."""
    every = [*[sort_key(f, c) for f, c in keys], tie]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in every]


def places(found: DataFrame, keys: Sequence[Column], descending: bool, name: str) -> DataFrame:
    """``found`` with the place of each row in the order of :func:`ordering`, from 1.

    Rows are dealt into ranges of keys, numbered there, and moved by the rows in the ranges before. The borders come from
    the rows of the least hashes; they decide the sizes of the ranges only, and any borders give the same places.
    """
    keyed = found.withColumn("__key", F.struct(*[c.alias(f"_{i}") for i, c in enumerate(keys)]))
    some = keyed.select("__key").orderBy(F.xxhash64("__key"), "__key").limit(_RANGES * _DRAWN)
    fields = keyed.schema["__key"].dataType.fields
    drawn = [r[0] for r in some.orderBy("__key").collect()][_DRAWN - 1 :: _DRAWN]
    borders = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(k, fields, strict=True)]) for k in drawn])
    steps = F.array(*[F.lit(_RANGES >> i) for i in range(_RANGES.bit_length())])
    halving = lambda n, step: n + F.when(F.coalesce(F.get(borders, n + step - 1) <= F.col("__key"), F.lit(False)), step).otherwise(0)
    dealt = keyed.withColumn("__range", F.aggregate(steps, F.lit(0), halving) if drawn else F.lit(0))
    order = [F.desc_nulls_last, F.asc_nulls_first][not descending]
    earlier = Window.orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    moved = sizes.select("__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(order("__key")))
    numbered = dealt.withColumn("__within", within).join(F.broadcast(moved), "__range")
    return numbered.withColumn(name, F.col("__before") + F.col("__within")).drop("__key", "__range", "__before", "__within")


def select(
    binding: Binding,
    query: str,
    fields: Sequence[str | FieldId] | None = None,
    sort_by: Sequence[str | FieldId] = (),
    limit: int | None = None,
    reverse: bool = False,
    *,
    top: bool = False,
    arrival: Sequence[Column] = (),
    default_field: str = "message",
    clock: Clock = system_clock,
    postings: DataFrame | None = None,
    stats=None,
    keep: Sequence[Column] = (),
    place: str | None = None,
) -> DataFrame:
    """``event_id`` and the chosen fields (columns named ``type:name``) of the matching events.

    ``limit`` keeps the smallest keys, and ``reverse`` then shows them in descending order; with ``top`` the largest
    are kept. Without ``sort_by`` the order is that of ``arrival`` and the event id. ``postings`` switches to index
    mode. ``keep`` adds columns. ``place`` adds the place in the order under this name instead of sorting, without a limit.
    """
    node = matcher(query, binding, default_field, clock)
    if stats is not None:
        stats.load(needed(node))
        node = order(node, stats)
    chosen = None if fields is None else [f for f in map(FieldId.of, fields) if binding.knows(f)]
    keys = [(f, binding.column(f)) for f in map(FieldId.of, sort_by) if binding.knows(f)]
    table = binding.table
    if postings is None:
        found = table.where(scan.column(node, binding.column))
    else:
        ids = index.ids(node, postings, table.select(binding.event_id.alias("event_id")), stats).withColumnRenamed("event_id", "__id")
        found = table.join(ids, binding.event_id == F.col("__id"), "left_semi")
    tie = binding.event_id
    lead = keys or [(FieldId(FieldType.LITERAL, "arrival"), c) for c in arrival]
    if place is not None:
        if limit is not None:
            raise ValueError("places are of all events: no limit")
        found, keep = places(found, [*[sort_key(f, c) for f, c in lead], tie], reverse, place), [*keep, F.col(place)]
    elif limit is not None:
        found = found.orderBy(*ordering(lead, tie, reverse and top)).limit(limit)
    if place is None and (limit is None or (reverse and not top)):
        if sort_by or arrival or reverse or limit is not None:
            found = found.orderBy(*ordering(lead, tie, reverse))
    return found.select(tie.alias("event_id"), *binding.named(chosen), *keep)


def explained(binding: Binding, query: str, default_field: str = "message", stats=None) -> str:
    node = matcher(query, binding, default_field)
    if stats is not None:
        stats.load(needed(node))
        node = order(node, stats)
    return explain(node, stats=stats)
