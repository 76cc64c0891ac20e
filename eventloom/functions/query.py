"""Functions of the search language: evaluated once, when a query is parsed."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from ..plans.ast import Range, Value
from ..types import FieldType

Clock = Callable[[], datetime]


def system_clock() -> datetime:
    return datetime.now(UTC)


def _cidr(args: str, clock: Clock) -> Range:
    network, slash, bits = args.strip().partition("/")
    octets = network.split(".")
    if not slash or not 1 <= len(octets) <= 4 or not bits.isdigit():
        raise ValueError(f"expected a.b.c.d/n, got {args!r}")
    padded = ".".join(octets + ["0"] * (4 - len(octets)))
    found = ipaddress.ip_network(f"{padded}/{int(bits)}", strict=False)
    ends = [Value(FieldType.ADDRESS, str(found[i])) for i in (0, -1)]
    return Range(FieldType.ADDRESS, ends[0], ends[1], False, False)


def _now(args: str, clock: Clock) -> Value:
    """The present instant. A zone is checked; it does not change the instant."""
    if args.strip():
        ZoneInfo(args.strip())
    now = clock().astimezone(UTC)
    return Value(FieldType.DATETIME, now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z")


def _typed(kind: FieldType):
    return lambda args, clock: Value(kind, args if kind in (FieldType.TEXT, FieldType.LITERAL) else args.strip())


REGISTRY: dict[str, Callable[[str, Clock], Value | Range]] = {"cidr": _cidr, "now": _now} | {k.value: _typed(k) for k in FieldType}


def call(name: str, args: str, clock: Clock = system_clock) -> Value | Range:
    if name not in REGISTRY:
        raise ValueError(f"unknown function {name!r}")
    return REGISTRY[name](args, clock)
