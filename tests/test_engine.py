"""The service object, stores on disk, index mode, routes and streaming ingest."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.catalog import Binding, Store
from eventloom.engine import BadRequest, Engine, NotFound, RetryLater
from eventloom.functions import values
from eventloom.operators import postings, routing, search, stats
from eventloom.plans import matchers
from eventloom.sources import syslog
from eventloom.sources.framing import FramingError, decode_frames, encode_frame
from eventloom.sources.network import Listener, _Inbox
from eventloom.streaming import ingest
from eventloom.types import FieldId, address_bytes

FIELDS = "event_id string, `text:message` string, `literal:kind` string, `integer:n` long, `float:x` double, `datetime:t` timestamp_ntz, `address:ip` binary, `hostname:host` string"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("e1", "the quick brown fox", "a", 1, 0.5, datetime(2020, 1, 1), address_bytes("10.0.0.1"), "www.example.com"),
        ("e2", "quick the brown the quick", "b", 2, None, datetime(2020, 1, 2), address_bytes("10.0.0.200"), "example.org"),
        ("e3", "  The\tQUICK  fox ", "A", None, -1.5, None, None, None),
        ("e4", None, None, 2, float("nan"), datetime(2019, 1, 1), address_bytes("::1"), "m.www.example.com"),
        ("e5", "", "a b", 7, 2.0, datetime(2020, 1, 2), address_bytes("200.1.1.1"), "com.example"),
    ]
    return spark.createDataFrame(rows, FIELDS)


@pytest.fixture(scope="module")
def binding(events):
    return Binding(events, F.col("event_id"), {FieldId.of(c): F.col(f"`{c}`") for c in events.columns[1:]})


CASES = {
    "quick": "e1 e2 e3",
    '"the quick"': "e1 e2 e3",
    '"the _ fox"': "e3",
    '"quick brown"': "e1",
    '"brown _ quick"': "e2",
    '"the quick the"': "",
    '"_ quick _"': "e1 e2 e3",
    '"_"': "e1 e2 e3 e5",
    "?kind = :a": "e1",
    "?kind = literal(a b)": "e5",
    "?kind != :a": "e2 e3 e4 e5",
    "?n = 2": "e2 e4",
    "?n > 1": "e2 e4 e5",
    "?n = [1 TO 2}": "e1",
    "?n != [1 TO 2]": "e3 e5",
    "?x <= 0.5": "e1 e3",
    "?t = 2020-01-02T00:00:00.000Z": "e2 e5",
    "?t < 2020-01-02T00:00:00.000Z": "e1 e4",
    "?ip = @10.0.0.1": "e1",
    "?ip = cidr(10.0.0.0/24)": "e1 e2",
    "?ip > @10.0.0.1": "e2 e5",
    "?host = @example.com": "e1 e4",
    "?host = @WWW.example.com": "e1 e4",
    "?host = @com": "e1 e4 e5",
    "NOT quick": "e4 e5",
    "quick AND NOT ?kind = :a AND NOT ?n = 2": "e3",
    "?nowhere = 1 OR ?n = 7": "e5",
    "NOT ?nowhere = 1": "e1 e2 e3 e4 e5",
    "?nowhere = 1": "",
}


@pytest.mark.parametrize("query", list(CASES))
def test_search_by_scan_and_index(binding, query):
    rows = postings.build(binding.events(), {f: F.col(f"`{f}`") for f in binding.fields})
    for index in (None, rows):
        if index is not None and query == '"_"':
            continue  # the index holds no words of a blank text
        found = search.select(binding, query, [], postings=index)
        assert " ".join(sorted(r[0] for r in found.collect())) == CASES[query], index


def test_order_and_limits(binding):
    ids = lambda **o: " ".join(r[0] for r in search.select(binding, "NOT ?n = -1", [], **o).collect())
    assert ids(sort_by=["integer:n"]) == "e3 e1 e2 e4 e5"
    assert ids(sort_by=["integer:n"], reverse=True) == "e5 e4 e2 e1 e3"
    assert ids(sort_by=["integer:n"], limit=2) == "e3 e1"
    assert ids(sort_by=["integer:n"], limit=2, reverse=True) == "e1 e3"
    assert ids(sort_by=["integer:n"], limit=2, reverse=True, top=True) == "e5 e4"
    assert ids(sort_by=["datetime:t", "integer:n"]) == "e3 e4 e1 e2 e5"
    assert ids(sort_by=["hostname:host"]) == "e3 e1 e4 e5 e2"
    assert ids(limit=0) == "" and ids(limit=2, reverse=True) == "e2 e1"


def test_engine(spark, events, tmp_path):
    engine = Engine(spark, str(tmp_path))
    store = engine.stores.create("logs")
    store.append(events, [FieldId.of(c) for c in events.columns[1:]])
    store.analyze()
    for index in (None, True, False):
        result = engine.search("quick", "logs", ["integer:n", "literal:kind"], ["integer:n"], index=index)
        page = result.events(0, 2)
        assert page.events == [("e3", {"b": "A"}), ("e1", {"a": 1, "b": "a"})] and not page.finished
        assert result.events(2, 5).finished and result.describe()["numSent"] == 3
    assert '"fields": {"a": ["INTEGER", "n"]' in page.json()
    assert engine.explain("fox AND quick", "logs").startswith('AND  ~2\n  text:message="fox"  ~2\n')
    assert engine.query(result.id) is result
    engine.delete_query(result.id)
    for failing, error in ((lambda: engine.query(result.id), NotFound), (lambda: engine.search("a b", "logs"), BadRequest), (lambda: engine.search("a", "no"), NotFound), (lambda: engine.stores.create("logs"), BadRequest), (lambda: engine.sources.get("x"), NotFound)):
        with pytest.raises(error):
            failing()
    again = Engine(spark, str(tmp_path))
    assert again.stores.list() == ["logs"] and again.stores.get("logs").created.keys() == store.created.keys()
    later = engine.search("quick", "logs")
    later.events()
    later.finished_at -= 60
    engine.expire()
    assert later.id not in engine.results
    engine.stores.delete("logs")
    assert engine.stores.list() == []


def test_sources_and_routes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.sources.create(name="in", kind="syslog_tcp", port=5140, tls={"keystore": "k", "keystore_password": "p", "client_auth": "requested"})
    with pytest.raises(BadRequest):
        engine.sources.create(name="bad", kind="carrier-pigeon")
    a, b, c = (routing.Route(n, (routing.MatchTag(n),), routing.Store((n,))) for n in "abc")
    engine.routes.append(a)
    engine.routes.insert(0, b)
    engine.routes.replace(1, c)
    assert engine.routes.list() == [b, c]
    for failing, error in ((lambda: engine.routes.delete(5), BadRequest), (lambda: engine.routes.insert(-1, a), BadRequest), (lambda: engine.routes.append(a, version=0), RetryLater)):
        with pytest.raises(error):
            failing()
    again = Engine(spark, str(tmp_path))
    assert again.routes.list() == [b, c] and again.sources.get("in") == engine.sources.get("in")
    assert routing.from_json({"name": "x", "matches": [{"matchType": "match-tag", "tag": "t"}], "action": {"actionType": "drop-action"}}) == routing.Route("x", (routing.MatchTag("t"),), routing.Drop())
    engine.routes.delete(0)
    engine.routes.flush()
    engine.sources.delete("in")
    assert engine.routes.list() == [] and engine.sources.list() == []
    assert Listener.of({"name": "u", "kind": "syslog_udp"}).port == 514


def test_framing():
    one, two = encode_frame(b"hello"), encode_frame("grüß".encode())
    assert decode_frames(b"", one + two) == ([b"hello", "grüß".encode()], b"")
    assert decode_frames(b"", one[:3]) == ([], one[:3]) and decode_frames(one[:3], one[3:] + b"1") == ([b"hello"], b"1")
    assert decode_frames(b"", b"") == ([], b"")
    for bad in (b"05 hello", b"x hello", b"11 hello world", b"123456"):
        with pytest.raises(FramingError):
            decode_frames(b"", bad, limit=10)


def test_syslog(spark):
    frames = [
        '<34>1 2003-10-11T22:14:15.003Z Host.example.com su - ID47 [a@1 k="1" k="x\\]\\"\\\\y\\z"][b] hello  world',
        "<165>2003-08-24T05:14:15.000003-07:00 192.0.2.1 msg here",
        "<0>1 - host - - - -",
        "<192>1 - host - - - - x",
        "<034>1 - host - - - - x",
        "<1>1 2003-13-41T22:14:15Z host a b c - x",
        '<1>1 - host a b c [a k="]"] x',
        None,
    ]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "i int, frame string")
    first, second, third, *bad = syslog.parse(rows).orderBy("i").collect()
    assert (first.facility, first.severity, first.version, first.origin, first.procid, first.message) == ("auth", "crit", 1, "host.example.com", "-", "hello  world")
    assert first.timestamp == datetime(2003, 10, 11, 22, 14, 15, 3000) and first.sd == {"a@1": {"k": ["1", 'x]"\\y\\z']}, "b": {}}
    assert (second.version, second.timestamp, second.origin, second.message) == (0, datetime(2003, 8, 24, 12, 14, 15), "192.0.2.1", "msg here")
    assert (third.valid, third.facility, third.severity, third.timestamp, third.message) == (True, "kern", "emerg", None, None)
    assert [r.valid for r in bad] == [False, False, True, False, False] and bad[2].timestamp is None


def test_syslog_is_cut_as_the_pattern_matched(spark):
    """Line ends, byte order marks, blanks and brackets at the borders of the parts."""
    frames = ["<13>- host\n", "<13>- host text\n", "<13>1 - h a p m -\n", "<13>1 - h a p m - \ufeffx y\n", "\ufeff<13>1 - h a p m [a]\r\n", "<13>1 - h a p m [a] ", "<13>1 - h a p\t m - x", "<13>1 - h  p m - x", "<13>1 - h a p m [a] [b] x"]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "i int, frame string")
    found = [(r.valid, r.version, r.origin, r.message) for r in syslog.parse(rows).orderBy("i").collect()]
    assert found[:6] == [(True, 0, "host", None), (True, 0, "host", "text\n"), (True, 1, "h", None), (True, 1, "h", "x y\n"), (True, 1, "h", None), (True, 1, "h", None)]
    assert found[6:8] == [(False, None, None, None)] * 2 and found[8] == (True, 1, "h", "[b] x")


def test_structured_data_with_and_without_python(spark):
    texts = ["-", "", None, "[a]", '[a k="1" k="2" j=""]', '[a k="x\\]\\"\\\\y\\z"][b][a j="2"]', '[a [x="v"]', '[a  k="v"  ]', '[a k="l\\\nm\nn"]', '[a\u00a0b \u00e9\u00a0="\u2028\\\u2028"]', '[a k="' + "x" * 40_000 + '"]']
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", syslog.structured_data(F.col("t")).alias("one"), syslog._native(F.col("t")).alias("two"), F.expr("length(t) > 32768").alias("long")).collect()
    assert [r.one for r in found] == [r.two or {} for r in found]
    assert found[5].one == {"a": {"j": ["2"]}, "b": {}} and found[8].one == {"a": {"k": ["l\\\nm\nn"]}} and found[4].one == {"a": {"k": ["1", "2"], "j": [""]}}


def test_each_message_meets_the_patterns_once(spark):
    """A filter on valid messages does not match again, structured data is parsed once, an address meets few patterns."""
    from eventloom import queries

    text = {n: queries.QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for n in ("syslog_version_0", "syslog_sd", "syslog_typed_values", "syslog_ipv6_value")}
    for name in text:
        assert text[name].count("(?s)^<(0|") == 2, name
    assert all(text[n].count("ArrowEvalPython") == 1 for n in text if n != "syslog_version_0")
    assert text["syslog_ipv6_value"].count("[1-9]?[0-9])") <= 6


FRAMES = [
    '<13>1 2020-01-01T00:00:00Z h1 app - - [source@42785 tag="red"][schema@42785 u="integer:user" w="address:peer"] one',
    '<13>1 2020-01-01T00:00:01Z h1 app - - [values@42785 u="42" w="10.0.0.9" z="lost"] two',
    "<13>1 2020-01-01T00:00:02Z h1 app - - [source@42785] three",
    "nonsense",
]


def _chunks():
    data = b"".join(encode_frame(f.encode()) for f in FRAMES)
    cuts = [0, 50, 51, 200, len(data)]
    return [("c1", i, data[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] + [("c2", 0, encode_frame(FRAMES[1].encode())), ("c2", 1, b"x y"), ("c2", 2, encode_frame(FRAMES[1].encode()))]


def test_stream_equals_batch_and_is_delivered(spark, tmp_path):
    chunks = spark.createDataFrame(_chunks(), ingest.SCHEMA)
    batch = ingest.frames(chunks)
    expected = sorted((r.conn_id, r.frame, tuple(r.tags), len(r.schema)) for r in batch.collect())
    assert len(expected) == 5 and {e[2] for e in expected} == {("red",), ()}
    for i in (True, False):  # two files: the second continues the connections of the first
        chunks.where((F.col("seq") < 2) == i).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    stores = {n: Store(spark, n, str(tmp_path / n)) for n in ("red", "rest")}
    chain = routing.RoutingChain([routing.Route("red", (routing.MatchTag("red"),), routing.Store(("red",))), routing.Route("rest", (routing.MatchAll(),), routing.StoreAll())])
    stream = spark.readStream.schema(ingest.SCHEMA).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    query = ingest.start(stream, chain, stores, str(tmp_path / "check"), availableNow=True)
    assert query.awaitTermination(120)
    red, rest = (stores[n].binding() for n in ("red", "rest"))
    assert red.table.count() == 4 and rest.table.count() == 2  # what goes to all stores goes to the red one too
    assert FieldId.of("integer:user") in stores["red"].created
    hit = search.select(red, "two AND ?user = 42 AND ?peer = @10.0.0.9", ["text:message"]).collect()
    assert [r["text:message"] for r in hit] == ["two"]
    by_index = search.select(red, "two", [], postings=stores["red"].postings()).collect()
    assert sorted(by_index) == sorted(search.select(red, "two", []).collect()) and len(by_index) == 2


def test_datagrams_and_odd_values(spark, tmp_path):
    """Datagrams are frames of their own; a name declared twice, and a date-time out of range, stop nothing."""
    frames = [
        '<13>1 - h app - - [schema@42785 a="integer:n" b="integer:n" t="datetime:at"][values@42785 a="1" b="2" t="9223372036854775807"] one',
        "<13>1 - h app - - - two",
    ]
    rows = [("p", i, f.encode()) for i, f in enumerate(frames)]
    spark.createDataFrame(rows, ingest.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, "all", str(tmp_path / "all"))
    chain = routing.RoutingChain([routing.Route("all", (routing.MatchAll(),), routing.StoreAll())])
    stream = spark.readStream.schema(ingest.SCHEMA).parquet(str(tmp_path / "in"))
    query = ingest.start(stream, chain, {"all": store}, str(tmp_path / "check"), framed=False, availableNow=True)
    assert query.awaitTermination(120)
    found = store.binding().table.collect()
    assert sorted(r["text:message"] for r in found) == ["one", "two"]
    assert [r["integer:n"] for r in found if r["text:message"] == "one"] == [1]


def test_retried_batches_and_metrics(spark, tmp_path):
    """A batch that is delivered twice is there once; the query's progress counts frames."""
    spark.createDataFrame([("p", i, f.encode()) for i, f in enumerate(FRAMES)], ingest.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, "all", str(tmp_path / "all"))
    chain = routing.RoutingChain([routing.Route("all", (routing.MatchAll(),), routing.StoreAll())])
    stream = spark.readStream.schema(ingest.SCHEMA).parquet(str(tmp_path / "in"))
    query = ingest.start(stream, chain, {"all": store}, str(tmp_path / "check"), framed=False, availableNow=True)
    assert query.awaitTermination(120)
    counted = [p["observedMetrics"]["ingest"] for p in query.recentProgress if p["numInputRows"]]
    assert [(m["frames"], m["unparsable"]) for m in counted] == [(4, 1)]
    batch = ingest.events(ingest.frames(spark.read.schema(ingest.SCHEMA).parquet(str(tmp_path / "in")), framed=False))
    for _ in range(2):
        ingest.deliver(batch, chain, {"all": store}, "again")
    assert store.binding().table.count() == 6 and store.postings().where("term = 'two'").count() == 2


def test_catalog_versions(spark, tmp_path):
    """Of two engines that save the same version one is told to retry, and then sees the other's edit."""
    one, two = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    one.stores.create("a")
    two.catalog.version = 0
    with pytest.raises(RetryLater):
        two.save()
    assert two.stores.list() == ["a"] and two.catalog.version == 1
    two.stores.create("b")
    one.refresh()
    assert one.stores.list() == ["a", "b"]


def test_costs_of_typed_terms(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), 1, 0.5 * i, datetime(2020, 1, 1, 0, 0, 0, 500000)) for i in range(20)], "event_id string, `integer:n` long, `float:x` double, `datetime:t` timestamp_ntz")
    store = Store(spark, "s", str(tmp_path))
    store.append(rows, [FieldId.of(f) for f in ("integer:n", "float:x", "datetime:t")])
    store.analyze()
    found = store.frequencies()
    for query, cost in (("?n = 1", 20), ("?n = 2", 0), ("?x = 2.5", 1), ("?t = 2020-01-01T00:00:00.500Z", 20), ("?n > 0", 20)):
        node = search.matcher(query, store.binding())
        found.load(search.needed(node))
        assert matchers.cost(node, found) == cost


def test_ipv6(spark):
    texts = ["::1", "::", "1::", "2001:db8::FFFF:1", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1", "1:2::3:4.5.6.7", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", ":1:2", "1::2::3", "12345::", "g::", "1:2", "::1.2.3", "1:2:3:4:5:6:7:8:9", "", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", values.ipv6(F.col("t")).alias("v")).collect()
    for r in found:
        try:
            expected = address_bytes(r.t) if r.t and ":" in r.t else None
        except ValueError:
            expected = None
        assert (None if r.v is None else bytes(r.v)) == expected, r.t


def test_inbox():
    """Numbers go on from the checkpoint's offset; without room datagrams are dropped and counted."""
    inbox = _Inbox(100, 10)
    for i in range(3):
        inbox.add("c", i, b"12345", wait=False)
    assert inbox.between(100) == ([("c", 0, b"12345"), ("c", 1, b"12345")], 102) and inbox.dropped == 1
    inbox.forget(101)
    inbox.add("c", 3, b"12345", wait=True)
    assert inbox.between(101) == ([("c", 1, b"12345"), ("c", 3, b"12345")], 103)
    inbox.forget(500)
    assert inbox.between(103) == ([], 103)


def test_statistics(spark):
    terms = spark.createDataFrame([("hello",)] * 3 + [("world",)], "term string")
    assert stats.term_count(terms).first()[0] == 4
    assert dict(stats.term_frequency(terms).collect()) == {"hello": 3, "world": 1}
    assert stats.hll_cardinality(stats.hll(terms)).first()["cardinality"] == 2
    assert dict(stats.estimate_frequency(stats.count_min(terms), terms).collect()) == {"hello": 3, "world": 1}
    asked = spark.createDataFrame([("hello",), ("world",), ("foo",)], "term string")
    assert dict(stats.maybe_member(stats.bloom(terms, 640), asked, 640).collect()) == {"hello": True, "world": True, "foo": False}


def test_advance_survives_bad_frames():
    rows = pd.DataFrame({"seq": [0, 1], "data": [b"5 hello", b"zz"]})
    leftover, sticky, found = ingest.advance(b"", {}, rows, True, 100)
    assert [r[2] for r in found] == ["hello"] and sticky["broken"] and leftover == b""


def test_batch_frames_hold_a_part_of_a_connection():
    """Frames come out before their connection's chunks are all read; state goes on across batches, and ends with its connection."""
    import pyarrow as pa

    read = []

    def batches():
        for i in range(40):
            read.append(i)
            tag = '[source@42785 tag="t"][schema@42785 a="integer:n"]' if i == 0 else "-"
            data = encode_frame(f"<13>1 - h app - - {tag} {'x' * 100}".encode())
            rows = [data[:20], *[data[20:] + data[:20]] * 998, data[20:]]
            yield pa.RecordBatch.from_pydict({"conn_id": ["a" if i < 39 else None] * 1000, "seq": [i * 1000 + k for k in range(1000)], "data": rows})

    found, begun = [], None
    for b in ingest._in_order(True, 1000)(batches()):
        begun = len(read) if begun is None else begun
        assert b.num_rows <= 4096
        found += b.to_pylist()
    assert begun < 10 and len(found) == 40 * 999
    assert {(r["conn_id"], tuple(r["tags"]), tuple(r["schema"])) for r in found} == {("a", ("t",), (("a", "integer:n"),)), (None, (), ())}
    assert [r["seq"] for r in found] == sorted(r["seq"] for r in found)


def test_cli(spark, events, tmp_path, capsys):
    from eventloom.cli import main

    engine = Engine(spark, str(tmp_path))
    engine.stores.create("logs").append(events, [FieldId.of("text:message")], index=False)
    assert main(["--path", str(tmp_path), "--store", "logs", "--fields", "text:message", "fox"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 2
    assert main(["--path", str(tmp_path), "--store", "none", "fox"]) == 1
