from datetime import UTC, datetime

import pytest

from eventloom.functions.query import call
from eventloom.functions.values import short_key
from eventloom.plans.ast import All, And, AnyOf, Between, Compare, Every, Not, Nothing, Or, Phrase, Range, Term, Value, Without, print_tree
from eventloom.plans.language import QueryError, parse_query
from eventloom.plans.matchers import cost, explain, order, plan, prune
from eventloom.types import FieldId, FieldType, address_bytes, address_text, instant

T = FieldType


def text(word, subject=None, op="="):
    return Compare(subject, op, Value(T.TEXT, word))


@pytest.mark.parametrize(
    ("query", "kind", "raw"),
    [
        ("?f = word", T.TEXT, "word"),
        ('?f = "two words"', T.TEXT, "two words"),
        ("?f = :lit-eral/x", T.LITERAL, "lit-eral/x"),
        ("?f = 42", T.INTEGER, "42"),
        ("?f = -42", T.INTEGER, "-42"),
        ("?f = 3.14", T.FLOAT, "3.14"),
        ("?f = -3.14", T.FLOAT, "-3.14"),
        ("?f = 2012-11-10T10:20:30.123Z", T.DATETIME, "2012-11-10T10:20:30.123Z"),
        ("?f = 2012-11-10T10:20:30.123+02:00", T.DATETIME, "2012-11-10T10:20:30.123+02:00"),
        ("?f = @127.0.0.1", T.ADDRESS, "127.0.0.1"),
        ("?f = @::1", T.ADDRESS, "::1"),
        ("?f = @www.example.com", T.HOSTNAME, "www.example.com"),
        ("?f = text(two words)", T.TEXT, "two words"),
        ("?f = literal(two words)", T.LITERAL, "two words"),
        ("?f = integer(42)", T.INTEGER, "42"),
        ("?f = float(3.14)", T.FLOAT, "3.14"),
        ("?f = datetime(2012-11-10)", T.DATETIME, "2012-11-10"),
        ("?f = address(127.0.0.1)", T.ADDRESS, "127.0.0.1"),
        ("?f = hostname(www.example.com)", T.HOSTNAME, "www.example.com"),
    ],
)
def test_values(query, kind, raw):
    assert parse_query(query) == Compare("f", "=", Value(kind, raw))


@pytest.mark.parametrize("op", ["=", "!=", ">", "<", ">=", "<="])
def test_operators(op):
    assert parse_query(f"?f {op} 1") == Compare("f", op, Value(T.INTEGER, "1"))


def test_precedence():
    a, b, c = text("a"), text("b"), text("c")
    assert parse_query("a OR b AND c") == Or((a, And((b, c))))
    assert parse_query("(a OR b) AND c") == And((Or((a, b)), c))
    assert parse_query("NOT a AND b") == And((Not(a), b))
    assert parse_query("NOT (a AND b)") == Not(And((a, b)))
    assert parse_query("a AND b AND c") == And((a, b, c))
    assert parse_query("NOT NOT a") == Not(Not(a))
    assert parse_query("NOTa") == text("NOTa")


def test_ranges():
    one, five = Value(T.INTEGER, "1"), Value(T.INTEGER, "5")
    for query, low, high, ends in (("[1 TO 5]", one, five, (False, False)), ("{1 TO 5}", one, five, (True, True)), ("[1 TO 5}", one, five, (False, True)), ("[TO 5]", None, five, (False, False)), ("{1 TO]", one, None, (True, False))):
        assert parse_query(f"?f = {query}") == Compare("f", "=", Range(T.INTEGER, low, high, *ends))


@pytest.mark.parametrize("query", ["", "a b", "?f", "?f =", "?f > [1 TO 2]", "[1 TO 2.5]", "(a", "a)", "AND", "?f -> g(1)", "?f = nosuch(1)", "?f = integer(x)", "[TO]", "?f = cidr(1.2.3.4/99)", '?f = "open'])
def test_rejected(query):
    with pytest.raises(QueryError):
        parse_query(query)


def test_functions():
    found = call("cidr", "192.168.0/24")
    assert (found.low.raw, found.high.raw) == ("192.168.0.0", "192.168.0.255")
    assert call("cidr", "10.1.2.3/32").low == call("cidr", "10.1.2.3/32").high
    clock = lambda: datetime(2020, 1, 2, 3, 4, 5, 678000, tzinfo=UTC)
    assert call("now", "", clock).python == call("now", "Europe/Berlin", clock).python == datetime(2020, 1, 2, 3, 4, 5, 678000)


def test_planning():
    f = FieldId(T.TEXT, "message")
    a, b, c = (Term(f, x) for x in "abc")
    assert plan(parse_query("a AND a")) == a
    assert plan(parse_query("a AND NOT b AND NOT c")) == Without(a, AnyOf((b, c)))
    assert plan(parse_query("NOT a AND NOT b")) == Without(Every(), AnyOf((a, b)))
    assert plan(parse_query('"A _ c"')) == Phrase(f, ("a", None, "c"))
    assert plan(parse_query('"b a"')) != plan(parse_query('"a b"'))
    n = FieldId(T.INTEGER, "n")
    assert plan(parse_query("?n >= 3")) == Between(n, 3, None, False, False)
    assert plan(parse_query("?n < 3")) == Between(n, None, 3, False, True)
    assert plan(parse_query("?n != 3")) == Without(Every(), Term(n, 3))
    for query in ("?f > word", "?f = [a TO b]", "?f != @www.example.com"):
        with pytest.raises(QueryError):
            plan(parse_query(query))


def test_pruning():
    known = lambda f: f.name != "gone"
    p = lambda q: prune(plan(parse_query(q)), known)
    a = Term(FieldId(T.TEXT, "message"), "a")
    assert p("?gone = 1 OR a") == a and p("?gone = 1 AND a") == Nothing()
    assert p("NOT ?gone = 1") == Every() and p("a AND NOT ?gone = 1") == a


def test_cost_and_explain():
    counts = {"a": 5, "b": 2, "c": 9}
    stats = lambda field, term: 100 if field is None else counts.get(term, 0)
    node = plan(parse_query("a AND b AND (c OR a)"))
    assert cost(node, stats) == 2 and cost(plan(parse_query("c AND NOT b")), stats) == 7
    assert isinstance(node, All) and order(node, stats).children[0].term == "b"
    assert explain(plan(parse_query("a AND NOT b"))) == 'FILTER\n  text:message="b"\nFROM\n  text:message="a"\n'
    assert print_tree(parse_query("a OR NOT ?n = 1")) == "OR\n  ? = text(a)\n  NOT\n    n = integer(1)\n"


def test_types():
    assert FieldId.of("TEXT:message") == FieldId(T.TEXT, "message")
    assert address_text(address_bytes("10.0.0.1")) == "10.0.0.1" and address_bytes("10.0.0.1") < address_bytes("200.0.0.1")
    assert instant("2012-11-10T10:20:30.1+02:00") == datetime(2012, 11, 10, 8, 20, 30, 100000)
    for bad in ("x:y", "text", "text:"):
        with pytest.raises(ValueError):
            FieldId.of(bad)


def test_short_keys():
    assert [short_key(i) for i in (0, 12, 35, 68, 581, 10246)] == ["a", "m", "J", "be", "jf", "cGg"]
