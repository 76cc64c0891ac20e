"""The search language: lexer and recursive-descent parser.

::

    query   = and { OR and }
    and     = not { AND not }
    not     = NOT not | "(" query ")" | expression
    expression = subject op operand | operand          subject = "?" identifier
    op      = "=" | "!=" | ">=" | "<=" | ">" | "<"      (ranges and range functions after "=" and "!=" only)
    operand = range | function "(" text ")" | value
    range   = ("[" | "{") [value] TO [value] ("]" | "}")
    value   = "@" location | date-time | number | ":" literal | word | "quoted text"

Keywords end at word boundaries, numbers and offsets may be signed, functions may stand wherever a value may.
"""

from __future__ import annotations

import re

from ..functions.query import Clock, call, system_clock
from ..types import FieldType, address_bytes, hostname
from .ast import And, Compare, Not, Or, Range, Value


class QueryError(ValueError):
    """A query that cannot be parsed or does not apply to the field's type."""


_SPACE = re.compile(r"\s*")
_WORD = re.compile(r"[^\W\d][\w$]*|[$_][\w$]*")
_QUOTED = re.compile(r'"((?:[^"\x00-\x1f\x7f\\]|\\[\\\'"bfnrt]|\\u[0-9A-Fa-f]{4})*)"')
_LITERAL = re.compile(r":([^\s\x00-\x1f\x7f\[\]()}]*)")
_NUMBER = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+|\d+)(?![\w.])")
_STAMP = re.compile(r"\d[\d:.TZ+-]*")
_LOCATION = re.compile(r"@([^\s()\]}]+)")
_CALLED = re.compile(r"([^\W\d][\w$]*)\(")
_OPERATOR = re.compile(r"!=|>=|<=|=|>|<")
_KEYWORDS = {"AND", "OR", "NOT", "TO"}


class _Parser:
    def __init__(self, text: str, clock: Clock):
        self.text, self.at, self.clock = text, 0, clock

    def fail(self, expected: str):
        raise QueryError(f"expected {expected} at {self.at}: {self.text[self.at : self.at + 20]!r}")

    def take(self, pattern: re.Pattern) -> re.Match | None:
        start = _SPACE.match(self.text, self.at).end()
        m = pattern.match(self.text, start)
        if m:
            self.at = m.end()
        return m

    def keyword(self, word: str) -> bool:
        return self.take(re.compile(rf"{word}(?![\w$])")) is not None

    def query(self):
        found = self.any()
        if _SPACE.match(self.text, self.at).end() != len(self.text):
            self.fail("the end of the query")
        return found

    def _group(self, part, word: str, kind):
        children = [part()]
        while self.keyword(word):
            children.append(part())
        return children[0] if len(children) == 1 else kind(tuple(children))

    def any(self):
        return self._group(self.all, "OR", Or)

    def all(self):
        return self._group(self.negated, "AND", And)

    def negated(self):
        if self.keyword("NOT"):
            return Not(self.negated())
        if self.take(re.compile(r"\(")):
            found = self.any()
            if not self.take(re.compile(r"\)")):
                self.fail("')'")
            return found
        return self.expression()

    def expression(self) -> Compare:
        subject = self.take(re.compile(r"\?([^\W\d][\w$]*)"))
        if not subject:
            return Compare(None, "=", self.operand(True))
        op = self.take(_OPERATOR)
        if not op:
            self.fail("an operator")
        return Compare(subject[1], op[0], self.operand(op[0] in ("=", "!=")))

    def operand(self, ranges: bool) -> Value | Range:
        opening = self.take(re.compile(r"[\[{]")) if ranges else None
        if opening:
            return self.range(opening[0] == "{")
        value = self.value()
        if isinstance(value, Range) and not ranges:
            self.fail("a value, not a range")
        return value

    def range(self, low_open: bool) -> Range:
        low = None if self.keyword("TO") else self.end()
        if low is not None and not self.keyword("TO"):
            self.fail("TO")
        closing = self.take(re.compile(r"[\]}]"))
        high = None
        if not closing:
            high = self.end()
            closing = self.take(re.compile(r"[\]}]"))
        if not closing:
            self.fail("']' or '}'")
        if low is None and high is None:
            self.fail("a range with an end")
        if low and high and low.type is not high.type:
            raise QueryError(f"range from {low.type.value} to {high.type.value}")
        return Range((low or high).type, low, high, low_open, closing[0] == "}")

    def end(self) -> Value:
        value = self.value()
        if isinstance(value, Range):
            self.fail("a value, not a range")
        return value

    def value(self) -> Value | Range:
        before = self.at
        if m := self.take(_LOCATION):
            return self.location(m[1])
        if stamp := self.stamp():
            return self.checked(Value(FieldType.DATETIME, stamp))
        if m := self.take(_NUMBER):
            return self.checked(Value(FieldType.FLOAT if "." in m[0] else FieldType.INTEGER, m[0]))
        if m := self.take(_LITERAL):
            return Value(FieldType.LITERAL, m[1])
        if called := self.called():
            try:
                found = call(*called, self.clock)
            except ValueError as error:
                raise QueryError(f"{called[0]}: {error}") from None
            return found if isinstance(found, Range) else self.checked(found)
        if m := self.take(_QUOTED):
            return Value(FieldType.TEXT, m[1])
        m = self.take(_WORD)
        if not m or m[0] in _KEYWORDS:
            self.at = before
            self.fail("a value")
        return Value(FieldType.TEXT, m[0])

    def stamp(self) -> str | None:
        """A run of date-time characters with a time and a zone; whether it is a date-time is decided by its value."""
        before, m = self.at, self.take(_STAMP)
        if m and set("Z+-") & set(m[0].partition("T")[2]):
            return m[0]
        self.at = before
        return None

    def called(self) -> tuple[str, str] | None:
        """Name and argument text of a function, which ends at the first parenthesis that has no backslash before it."""
        before, m = self.at, self.take(_CALLED)
        args: list[str] = []
        while m and self.at < len(self.text):
            c = self.text[self.at]
            if c == ")":
                self.at += 1
                return m[1], "".join(args)
            if c == "\\":
                self.at += 1
                c = self.text[self.at : self.at + 1]
                if c != ")":
                    break
            elif ord(c) < 32 or ord(c) == 127:
                break
            args.append(c)
            self.at += 1
        self.at = before
        return None

    def checked(self, value: Value) -> Value:
        try:
            _ = value.python
        except (ValueError, KeyError) as error:
            raise QueryError(str(error)) from None
        return value

    def location(self, text: str) -> Value:
        try:
            address_bytes(text)
            return Value(FieldType.ADDRESS, text)
        except ValueError:
            pass
        try:
            hostname(text)
        except ValueError as error:
            raise QueryError(str(error)) from None
        return Value(FieldType.HOSTNAME, text)


def parse_query(text: str, clock: Clock = system_clock):
    """The syntax tree of a query; QueryError where it has none."""
    return _Parser(text, clock).query()
