"""Field types and identifiers, and how their values look in Spark.

A field is named by *(type, name)*; one name may exist under several types. Addresses are kept as 16 bytes (IPv4 mapped
into IPv6), so that byte order is the order of addresses; hostnames are lower-cased and ordered by reversed labels.
"""

from __future__ import annotations

import enum
import ipaddress
import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import types as T


class FieldType(enum.Enum):
    TEXT = "text"
    LITERAL = "literal"
    INTEGER = "integer"
    FLOAT = "float"
    DATETIME = "datetime"
    ADDRESS = "address"
    HOSTNAME = "hostname"

    @property
    def spark(self) -> T.DataType:
        return {"integer": T.LongType(), "float": T.DoubleType(), "datetime": T.TimestampNTZType(), "address": T.BinaryType()}.get(self.value, T.StringType())

    @property
    def ordered(self) -> bool:
        """Whether comparisons and ranges apply (text and hostnames only know equality)."""
        return self not in (FieldType.TEXT, FieldType.HOSTNAME)


@dataclass(frozen=True)
class FieldId:
    type: FieldType
    name: str

    @staticmethod
    def of(spec: str | FieldId) -> FieldId:
        """Reads ``type:name``; the type in any case."""
        if isinstance(spec, FieldId):
            return spec
        kind, colon, name = spec.partition(":")
        try:
            found = FieldType(kind.lower())
        except ValueError:
            raise ValueError(f"unknown field type in {spec!r}") from None
        if not colon or not name:
            raise ValueError(f"expected type:name, got {spec!r}")
        return FieldId(found, name)

    def __str__(self) -> str:
        return f"{self.type.value}:{self.name}"


def address_bytes(text: str) -> bytes:
    """16 bytes of an IPv4 or IPv6 address in text form."""
    found = ipaddress.ip_address(text)
    return found.packed if found.version == 6 else b"\0" * 10 + b"\xff\xff" + found.packed


def address_text(value: bytes) -> str:
    found = ipaddress.IPv6Address(bytes(value))
    return str(found.ipv4_mapped or found)


_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?)?(Z|[+-]\d\d:?\d\d)?$", re.I)


def instant(text: str) -> datetime:
    """A UTC date-time without zone, to the millisecond, from ISO-8601 text (no zone: UTC)."""
    m = _ISO.match(text.strip())
    if not m:
        raise ValueError(f"not an ISO-8601 date-time: {text!r}")
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    milli = int(((m[7] or "") + "000")[:3])
    found = datetime(year, month, day, hour, minute, second, milli * 1000, tzinfo=UTC)
    if m[8] and m[8].upper() != "Z":
        found = datetime.fromisoformat(found.replace(tzinfo=None).isoformat() + m[8])
    return found.astimezone(UTC).replace(tzinfo=None)


_HOST = re.compile(r"(?=.{1,255}$)[A-Za-z0-9_*-]{1,63}(?:\.[A-Za-z0-9_-]{1,63})*\.?$")


def hostname(text: str) -> str:
    if not _HOST.match(text):
        raise ValueError(f"not a host name: {text!r}")
    return text.lower().rstrip(".")


def parse(kind: FieldType, raw: str):
    """The Python value of a literal in a query."""
    if kind is FieldType.INTEGER:
        value = int(raw.strip())
        if not -(2**63) <= value < 2**63:
            raise ValueError(f"integer out of range: {raw}")
        return value
    if kind is FieldType.FLOAT:
        return float(raw.strip())
    if kind is FieldType.DATETIME:
        return instant(raw)
    if kind is FieldType.ADDRESS:
        return address_bytes(raw.strip())
    if kind is FieldType.HOSTNAME:
        return hostname(raw.strip())
    return raw
