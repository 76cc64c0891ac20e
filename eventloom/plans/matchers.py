"""From syntax trees to matcher trees: typing, rewriting, pruning, costing and printing."""

from __future__ import annotations

from ..types import FieldId, FieldType, address_text
from .ast import All, And, AnyOf, Between, Compare, Every, Not, Nothing, Or, Phrase, Range, Term, Value, Without
from .language import QueryError

PLACEHOLDER = "_"
_BOUNDS = {">": (True, True), ">=": (True, False), "<": (False, True), "<=": (False, False)}


def _leaf(node: Compare, default: str):
    operand = node.operand
    field = FieldId(operand.type, node.subject or default)
    if isinstance(operand, Value) and node.op == "=":
        if field.type is FieldType.TEXT:
            terms = tuple(None if t == PLACEHOLDER else t for t in operand.raw.lower().split())
            if not terms:
                return Nothing()
            return Term(field, terms[0]) if len(terms) == 1 and terms[0] else Phrase(field, terms)
        if field.type is FieldType.HOSTNAME:
            terms = tuple(operand.python.split("."))
            return Term(field, terms[0]) if len(terms) == 1 else Phrase(field, terms)
        return Term(field, operand.python)
    if not field.type.ordered:
        raise QueryError(f"{node.op} does not apply to {field.type.value} fields")
    if isinstance(operand, Range):
        ends = [e.python if e else None for e in (operand.low, operand.high)]
        found = Between(field, ends[0], ends[1], operand.low_open, operand.high_open)
        return Without(Every(), found) if node.op == "!=" else found
    if node.op == "!=":
        return Without(Every(), Term(field, operand.python))
    low, exclusive = _BOUNDS[node.op]
    return Between(field, operand.python if low else None, None if low else operand.python, exclusive and low, exclusive and not low)


def _unique(children) -> tuple:
    return tuple(dict.fromkeys(children))


def plan(node, default: str = "message"):
    """The matcher tree: equal children once, single children lifted, negations sifted."""
    if isinstance(node, Compare):
        return _leaf(node, default)
    if isinstance(node, Not):
        return Without(Every(), plan(node.child, default))
    children = _unique(plan(c, default) for c in node.children)
    if isinstance(node, Or):
        return children[0] if len(children) == 1 else AnyOf(children)
    assert isinstance(node, And)
    return _sift(children)


def _sift(children: tuple):
    """``a AND NOT b AND NOT c`` is ``a`` without ``b OR c``; what the negations draw from joins the positive side."""
    if len(children) == 1:
        return children[0]
    negative = [c for c in children if isinstance(c, Without)]
    positive = [c for c in children if not isinstance(c, Without)]
    if not negative:
        return All(children)
    source = [c for c in _unique([*positive, *(c.source for c in negative)]) if not isinstance(c, Every)]
    drop = _unique(c.filter for c in negative)
    whole = Every() if not source else source[0] if len(source) == 1 else All(tuple(source))
    return Without(whole, drop[0] if len(drop) == 1 else AnyOf(drop))


def prune(node, known):
    """Removes what cannot match: ``known`` tells whether a field exists."""
    if isinstance(node, Term | Phrase | Between):
        return node if known(node.field) else Nothing()
    if isinstance(node, All):
        children = tuple(prune(c, known) for c in node.children)
        if any(isinstance(c, Nothing) for c in children):
            return Nothing()
        children = _unique(c for c in children if not isinstance(c, Every))
        return Every() if not children else children[0] if len(children) == 1 else All(children)
    if isinstance(node, AnyOf):
        children = _unique(c for c in (prune(c, known) for c in node.children) if not isinstance(c, Nothing))
        if any(isinstance(c, Every) for c in children):
            return Every()
        return Nothing() if not children else children[0] if len(children) == 1 else AnyOf(children)
    if isinstance(node, Without):
        source, drop = prune(node.source, known), prune(node.filter, known)
        if isinstance(source, Nothing) or isinstance(drop, Every):
            return Nothing()
        return source if isinstance(drop, Nothing) else Without(source, drop)
    return node


def cost(node, stats) -> int:
    """An estimate of how many events match. ``stats(field, term or None)``: frequency of a term, or of all terms."""
    if isinstance(node, Term):
        return stats(node.field, node.term)
    if isinstance(node, Phrase):
        known = [stats(node.field, t) for t in node.terms if t is not None]
        return min(known) if known else stats(node.field, None)
    if isinstance(node, Between):
        return stats(node.field, None)
    if isinstance(node, All):
        return min(cost(c, stats) for c in node.children)
    if isinstance(node, AnyOf):
        return sum(cost(c, stats) for c in node.children)
    if isinstance(node, Without):
        return max(0, cost(node.source, stats) - cost(node.filter, stats))
    return 0 if isinstance(node, Nothing) else stats(None, None)


def order(node, stats):
    """Children of conjunctions from rare to frequent."""
    if isinstance(node, All):
        return All(tuple(sorted((order(c, stats) for c in node.children), key=lambda c: (cost(c, stats), repr(c)))))
    if isinstance(node, AnyOf):
        return AnyOf(tuple(order(c, stats) for c in node.children))
    return Without(order(node.source, stats), order(node.filter, stats)) if isinstance(node, Without) else node


def shown(value) -> str:
    return address_text(value) if isinstance(value, bytes) else "" if value is None else str(value)


def explain(node, indent: int = 0, stats=None) -> str:
    """A matcher tree as indented text, with estimates if statistics are given."""
    pad, note = " " * indent, f"  ~{cost(node, stats)}" if stats else ""
    deeper = lambda c: explain(c, indent + 2, stats)
    if isinstance(node, Term):
        return f'{pad}{node.field}="{shown(node.term)}"{note}\n'
    if isinstance(node, Phrase):
        inner = "".join(f"{pad}  {PLACEHOLDER}\n" if t is None else f'{pad}  {node.field}="{t}"\n' for t in node.terms)
        return f"{pad}PHRASE{note}\n{inner}"
    if isinstance(node, Between):
        ends = f'{"{" if node.low_open else "["}"{shown(node.low)}","{shown(node.high)}"{"}" if node.high_open else "]"}'
        return f"{pad}{node.field}={ends}{note}\n"
    if isinstance(node, All | AnyOf):
        return f"{pad}{'AND' if isinstance(node, All) else 'OR'}{note}\n" + "".join(map(deeper, node.children))
    if isinstance(node, Without):
        return f"{pad}FILTER{note}\n{deeper(node.filter)}{pad}FROM\n{deeper(node.source)}"
    return f"{pad}{'EVERY' if isinstance(node, Every) else 'NOTHING'}{note}\n"
