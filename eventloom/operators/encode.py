"""Events as JSON."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Binding
from ..functions.values import address_text, short_key
from ..types import FieldId, FieldType


def plain(field: FieldId, column: Column) -> Column:
    """A field's JSON value: date-times as epoch milliseconds, addresses as text."""
    if field.type is FieldType.DATETIME:
        return F.unix_millis(F.to_timestamp_ltz(F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))))
    return address_text(column) if field.type is FieldType.ADDRESS else column


def event_json(binding: Binding, fields: Sequence[FieldId] | None = None) -> Column:
    """``[id, {name: {TYPE: value}}]``; fields without a value are left out."""
    names: dict[str, list[FieldId]] = {}
    for f in binding.fields if fields is None else fields:
        names.setdefault(f.name, []).append(f)
    inner = []
    for name, ids in names.items():
        values = [plain(f, binding.column(f)).alias(f.type.name) for f in ids]
        present = reduce(lambda x, y: x | y, [binding.column(f).isNotNull() for f in ids])
        inner.append(F.when(present, F.struct(*values)).alias(name))
    wrapped = F.to_json(F.struct(binding.event_id.alias("v")))  # {"v":...}
    own = wrapped.substr(F.lit(6), F.length(wrapped) - 6)
    return F.concat(F.lit("["), own, F.lit(","), F.to_json(F.struct(*inner)), F.lit("]"))


def keyed_json(binding: Binding, fields: Sequence[FieldId]) -> Column:
    """``{short key: value}`` in the order of ``fields``."""
    return F.to_json(F.struct(*[plain(f, binding.column(f)).alias(short_key(i)) for i, f in enumerate(fields)]))
