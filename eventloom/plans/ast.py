"""Syntax trees of queries, and the matcher trees they are planned into. Frozen, so equal parts are equal."""

from __future__ import annotations

from dataclasses import dataclass

from ..types import FieldId, FieldType, parse


@dataclass(frozen=True)
class Value:
    type: FieldType
    raw: str

    @property
    def python(self):
        return parse(self.type, self.raw)


@dataclass(frozen=True)
class Range:
    type: FieldType
    low: Value | None
    high: Value | None
    low_open: bool
    high_open: bool

    def __str__(self) -> str:
        ends = (self.low.raw if self.low else "", self.high.raw if self.high else "")
        return f"{'{' if self.low_open else '['}{ends[0]} TO {ends[1]}{'}' if self.high_open else ']'}"


@dataclass(frozen=True)
class Compare:
    """``?subject op operand``; without a subject the default field is meant."""

    subject: str | None
    op: str
    operand: Value | Range


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


@dataclass(frozen=True)
class Not:
    child: object


# Matchers: what a planned query consists of.


@dataclass(frozen=True)
class Term:
    field: FieldId
    term: object  # a Python value; one token for text, one label for hostnames


@dataclass(frozen=True)
class Phrase:
    """Tokens at consecutive places; None stands for any token. Order and repeats count."""

    field: FieldId
    terms: tuple[str | None, ...]


@dataclass(frozen=True)
class Between:
    field: FieldId
    low: object | None
    high: object | None
    low_open: bool
    high_open: bool


@dataclass(frozen=True)
class Every:
    pass


@dataclass(frozen=True)
class Nothing:
    """Matches no event."""


@dataclass(frozen=True)
class All:
    children: tuple


@dataclass(frozen=True)
class AnyOf:
    children: tuple


@dataclass(frozen=True)
class Without:
    """What ``source`` matches and ``filter`` does not."""

    source: object
    filter: object


def print_tree(node, indent: int = 0) -> str:
    """A syntax tree as indented text."""
    pad = " " * indent
    if isinstance(node, Compare):
        operand = node.operand
        target = str(operand) if isinstance(operand, Range) else f"{operand.type.value}({operand.raw})"
        return f"{pad}{node.subject or '?'} {node.op} {target}\n"
    if isinstance(node, Not):
        return f"{pad}NOT\n{print_tree(node.child, indent + 2)}"
    name = "AND" if isinstance(node, And) else "OR"
    return f"{pad}{name}\n" + "".join(print_tree(c, indent + 2) for c in node.children)
