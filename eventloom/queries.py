"""The engine's queries over the driver's tables, and the same results in SQL.

Fields are bound to the tables as in a store; each query is a search string (or an operator) over whole tables.
Addresses appear as hex text, and columns are named as in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Binding
from .functions import values
from .operators import postings, routing, search, stats
from .operators.encode import event_json
from .sources import syslog
from .streaming import ingest
from .types import FieldId

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


# Bindings


def events(spark: SparkSession, sf_dir: str) -> Binding:
    fields = {
        "literal:event_type": "event_type",
        "integer:user_id": "user_id",
        "float:value": "value",
        "datetime:ts": "ts",
        "address:ip": values.ipv4_of_number(F.lit(167772160) + F.col("user_id")),
        "text:props": "props",
    }
    return Binding.of(read(spark, sf_dir, "events"), "event_id", fields, F.array("event_type"))


def documents(spark: SparkSession, sf_dir: str) -> Binding:
    return Binding.of(read(spark, sf_dir, "documents"), "doc_id", {"text:message": "text", "literal:lang": "lang", "literal:source": "source", "integer:n_chars": "n_chars"})


def labelled(spark: SparkSession, sf_dir: str) -> Binding:
    """Documents with sparse fields: most have no label."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return Binding.of(rows, "doc_id", {"text:message": "text", "integer:quality": F.col("quality").cast("long"), "integer:toxic": F.col("toxic").cast("long"), "literal:lang": "lang"})


def orders(spark: SparkSession, sf_dir: str) -> Binding:
    return Binding.of(read(spark, sf_dir, "orders"), "o_orderkey", {"integer:custkey": "o_custkey", "literal:status": "o_orderstatus", "float:total": "o_totalprice", "datetime:date": "o_orderdate", "literal:priority": "o_orderpriority"})


def pages(spark: SparkSession, sf_dir: str) -> Binding:
    return Binding.of(read(spark, sf_dir, "pages"), "page_id", {"hostname:host": F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)})


_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_IP = "'00000000000000000000FFFF' || printf('%08X', 167772160 + user_id)"
_EVENT = f"event_id, event_type, user_id, value, ts, {_IP} AS ip, props"
_TOKENS = "list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def _shown(found: DataFrame, id_name: str) -> DataFrame:
    """Columns by their plain names; addresses as hex."""
    out = [F.col("event_id").alias(id_name)]
    for c in found.columns[1:]:
        kind, _, name = c.partition(":")
        out.append((F.hex(f"`{c}`") if kind == "address" else F.col(f"`{c}`")).alias(name or c))
    return found.select(out)


def searched(name: str, binding, query: str, id_name: str, sql: str, **options) -> None:
    """Registers a search in scan mode."""

    @registered(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(search.select(binding(spark, sf_dir), query, **options), id_name)


def on_events(name: str, query: str, where: str, **options) -> None:
    searched(name, events, query, "event_id", f"SELECT {_EVENT} FROM events WHERE {where}", **options)


def on_orders(name: str, query: str, where: str) -> None:
    columns = "o_orderkey AS id, o_custkey AS custkey, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS date, o_orderpriority AS priority"
    searched(name, orders, query, "id", f"SELECT {columns} FROM orders WHERE {where}")


def on_documents(name: str, query: str, where: str, index: bool = False) -> None:
    """Registers a search of texts, and with ``index`` its twin by postings."""
    sql = f"SELECT doc_id FROM (SELECT doc_id, lang, source, n_chars, text, {_TOKENS} AS w FROM documents) WHERE {where}"
    searched(name, documents, query, "doc_id", sql, fields=[])
    if index:

        @registered(f"{name}_index", sql)
        def twin(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound = documents(spark, sf_dir)
            own = [leaf.field for leaf in search.leaves(search.matcher(query, bound))]
            rows = postings.build(bound.events(), {f: F.col(f"`{f}`") for f in own})
            return _shown(search.select(bound, query, [], postings=rows), "doc_id")


# Terms

on_events("term_literal", "?event_type = :error", "event_type = 'error'")
on_events("term_integer", "?user_id = 42", "user_id = 42")
on_events("term_float", "?value = 42.5 OR ?value = 17.25", "value IN (42.5, 17.25)")
on_events("term_datetime", "?ts = 2024-01-01T00:00:00.000Z OR ?ts < 2024-01-01T12:00:00.500Z", "ts < TIMESTAMP '2024-01-01 12:00:00.5'")
on_events("term_address", "?ip = @10.0.0.42", "user_id = 42")
on_events("term_coerced", "?event_type = literal(click) AND ?user_id = integer( 7 )", "event_type = 'click' AND user_id = 7")
on_documents("term_text", "?message = that", "list_contains(w, 'that')", index=True)
on_documents("term_default_field", "With", "list_contains(w, 'with')")
on_documents("term_text_punctuation", '"the," OR "and."', "list_contains(w, 'the,') OR list_contains(w, 'and.')")

# Functions

on_documents("func_text", "?message = text(of the)", "text LIKE '%' AND len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0")
on_events("func_float", "?value >= float( 100.5 )", "value >= 100.5")
on_events("func_datetime", "?ts < datetime(2024-01-02T00:00:00.000Z)", "ts < TIMESTAMP '2024-01-02'")
on_events("func_address", "?ip = address(10.0.0.42)", "user_id = 42")
on_events("func_now", "?ts <= now() AND ?user_id < 5", "ts IS NOT NULL AND user_id < 5")

# Comparisons

_COMPARED = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
for _name, _op in _COMPARED.items():
    on_events(f"cmp_{_name}_literal", f"?event_type {_op} :error", f"event_type {_op} 'error'")
    on_events(f"cmp_{_name}_integer", f"?user_id {_op} 50", f"user_id {_op} 50")
    on_events(f"cmp_{_name}_float", f"?value {_op} 100.5", f"value {_op} 100.5")
    on_orders(f"cmp_{_name}_datetime", f"?date {_op} 1996-01-01T00:00:00.000Z", f"o_orderdate {_op} TIMESTAMP '1996-01-01'")
    on_events(f"cmp_{_name}_address", f"?ip {_op} @10.0.0.50", f"user_id {_op} 50")
on_events("cmp_neq_literal", "?event_type != :error", "event_type <> 'error' OR event_type IS NULL")
on_events("cmp_neq_integer", "?user_id != 50", "user_id <> 50 OR user_id IS NULL")
on_events("cmp_neq_float", "?value != 100.5", "value <> 100.5 OR value IS NULL")
on_orders("cmp_neq_datetime", "?date != 1996-01-01T00:00:00.000Z", "o_orderdate <> TIMESTAMP '1996-01-01'")
on_events("cmp_neq_address", "?ip != @10.0.0.50", "user_id <> 50 OR user_id IS NULL")

# Ranges

for _name, _query, _where in (
    ("closed_ii", "[10 TO 20]", "user_id >= 10 AND user_id <= 20"),
    ("closed_ee", "{10 TO 20}", "user_id > 10 AND user_id < 20"),
    ("closed_ie", "[10 TO 20}", "user_id >= 10 AND user_id < 20"),
    ("closed_ei", "{10 TO 20]", "user_id > 10 AND user_id <= 20"),
    ("left_open_i", "[TO 20]", "user_id <= 20"),
    ("left_open_e", "[TO 20}", "user_id < 20"),
    ("right_open_i", "[20 TO]", "user_id >= 20"),
    ("right_open_e", "{20 TO]", "user_id > 20"),
):
    on_events(f"range_{_name}", f"?user_id = {_query}", _where)
on_events("range_not", "?user_id != [10 TO 60]", "NOT coalesce(user_id BETWEEN 10 AND 60, false)")
on_events("range_cidr", "?ip = cidr(10.0.0/28)", "user_id BETWEEN 0 AND 15")
on_events("range_literal", "?event_type = [:click TO :purchase}", "event_type >= 'click' AND event_type < 'purchase'")
on_orders("range_float", "?total = [1000.0 TO 50000.0}", "o_totalprice >= 1000 AND o_totalprice < 50000")
on_orders("range_datetime", "?date = {1995-01-01T00:00:00.000Z TO 1996-01-01T00:00:00.000Z]", "o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-01-01'")

# Boolean structure

on_events("bool_and", "?event_type = :error AND ?value > 100.0", "event_type = 'error' AND value > 100")
on_events("bool_or", "?event_type = :error OR ?user_id = 7", "event_type = 'error' OR user_id = 7")
on_events("bool_not", "NOT ?event_type = :error", "NOT coalesce(event_type = 'error', false)")
on_events("bool_and_not_not", "?value > 50.0 AND NOT ?event_type = :error AND NOT ?event_type = :click", "value > 50 AND NOT coalesce(event_type = 'error' OR event_type = 'click', false)")
on_events("bool_nested", "(?event_type = :error OR ?event_type = :click) AND (?user_id < 20 OR NOT ?value < 150.0)", "event_type IN ('error', 'click') AND (user_id < 20 OR NOT coalesce(value < 150, false))")
on_events("bool_precedence", "?user_id = 1 OR ?user_id = 2 AND NOT ?event_type = :click", "user_id = 1 OR (user_id = 2 AND NOT coalesce(event_type = 'click', false))")
on_events("bool_unknown_field", "?missing = 4 OR ?user_id = 3 AND NOT ?nowhere = :x", "user_id = 3")
on_events("bool_all_unknown", "?missing = 4 AND ?user_id = 3", "false")
searched("bool_missing_value_not", labelled, "?quality != 1 AND NOT ?toxic = 1", "doc_id", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 1, false) AND NOT coalesce(toxic = 1, false)", fields=[])

# Phrases


def _sql_phrase(*terms: str | None) -> str:
    tests = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(terms) if t is not None)
    return f"len(list_filter(range(1, len(w) - {len(terms) - 2}), lambda i: {tests})) > 0"


on_documents("phrase_2", '"of the"', _sql_phrase("of", "the"), index=True)
on_documents("phrase_3", '"the and the"', _sql_phrase("the", "and", "the"), index=True)
on_documents("phrase_placeholder", '"of _ the"', _sql_phrase("of", None, "the"), index=True)
on_documents("phrase_repeated_term", '"the the"', _sql_phrase("the", "the"), index=True)
on_documents("phrase_edge_placeholder", '"_ with _"', "list_contains(w, 'with')")
on_documents("phrase_only_placeholder", '"_"', "text IS NOT NULL")
on_documents("text_and_not", 'that AND NOT "of the" AND NOT ?lang = :fr', f"list_contains(w, 'that') AND NOT {_sql_phrase('of', 'the')} AND lang <> 'fr'", index=True)

# Hostnames


def on_hosts(name: str, query: str, where: str) -> None:
    searched(name, pages, query, "page_id", f"SELECT page_id, host FROM (SELECT page_id, {_HOST} AS host FROM pages) WHERE {where}")


on_hosts("hostname_exact", "?host = @tionsh.example.net", "regexp_matches('.' || lower(host) || '.', '[.]tionsh[.]example[.]net[.]')")
on_hosts("hostname_suffix", "?host = @Example.com", "regexp_matches('.' || lower(host) || '.', '[.]example[.]com[.]')")
on_hosts("hostname_label", "?host = hostname(org)", "list_contains(string_split(lower(host), '.'), 'org')")


@registered("hostname_order", f"SELECT page_id, host, row_number() OVER (ORDER BY list_reverse(string_split(lower(host), '.')), page_id) AS n FROM (SELECT page_id, {_HOST} AS host FROM pages) ORDER BY n LIMIT 50")
def hostname_order(spark, sf_dir):
    found = search.select(pages(spark, sf_dir), "NOT ?host = @none.invalid", sort_by=["hostname:host"], limit=50)
    return _numbered(_shown(found, "page_id"), [values.host_key(F.col("host")), F.col("page_id")])


# Order, limit, pages: the place in the order is part of the result


def _numbered(found: DataFrame, order: list[Column]) -> DataFrame:
    """Numbers the rows of a limited result in its order."""
    from pyspark.sql.window import Window

    return found.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long"))


_SORTED = "SELECT event_id, event_type, value, row_number() OVER (ORDER BY {0}) AS n FROM events WHERE {1}"
_FIELDS = ["literal:event_type", "float:value"]


def _sorted(name: str, sql: str, order: list, query: str = "?value > 1.0", **options) -> None:
    @registered(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.select(events(spark, sf_dir), query, _FIELDS, **options)
        return _numbered(_shown(found, "event_id"), [getattr(F.col(c), how)() for c, how in order])


_UP = [("event_type", "asc_nulls_first"), ("value", "asc_nulls_first"), ("event_id", "asc_nulls_first")]
_DOWN = [(c, "desc_nulls_last") for c, _ in _UP]
_UP_SQL = "event_type ASC NULLS FIRST, value ASC NULLS FIRST, event_id"
_DOWN_SQL = "event_type DESC NULLS LAST, value DESC NULLS LAST, event_id DESC"
_sorted("sort_multi", f"SELECT * FROM ({_SORTED.format(_UP_SQL, 'value > 1')}) ORDER BY n LIMIT 500", _UP, sort_by=_FIELDS, limit=500)
_sorted("topk", f"SELECT * FROM ({_SORTED.format(_UP_SQL, 'value > 150')}) ORDER BY n LIMIT 20", _UP, "?value > 150.0", sort_by=_FIELDS, limit=20)
_sorted("topk_reverse_top", f"SELECT * FROM ({_SORTED.format(_DOWN_SQL, 'value > 1')}) ORDER BY n LIMIT 20", _DOWN, sort_by=_FIELDS, limit=20, reverse=True, top=True)
_sorted(
    "topk_reverse_compat",
    f"SELECT event_id, event_type, value, row_number() OVER (ORDER BY {_DOWN_SQL}) AS n FROM (SELECT * FROM ({_SORTED.format(_UP_SQL, 'value > 1')}) ORDER BY n LIMIT 20)",
    _DOWN, sort_by=_FIELDS, limit=20, reverse=True,
)
_sorted("limit_zero", "SELECT event_id, event_type, value, 1::BIGINT AS n FROM events WHERE false", _UP, sort_by=_FIELDS, limit=0)


@registered("sort_reverse", f"SELECT event_id, value, row_number() OVER (ORDER BY {_DOWN_SQL}) AS n FROM events")
def sort_reverse(spark, sf_dir):
    found = search.select(events(spark, sf_dir), "NOT ?user_id = -1", _FIELDS, _FIELDS, reverse=True, place="n")
    return _shown(found, "event_id").select("event_id", "value", "n")


@registered("sort_nulls_first", "SELECT * FROM (SELECT doc_id, quality::BIGINT AS quality, row_number() OVER (ORDER BY quality ASC NULLS FIRST, doc_id) AS n FROM documents LEFT JOIN labels USING (doc_id)) ORDER BY n LIMIT 700")
def sort_nulls_first(spark, sf_dir):
    found = search.select(labelled(spark, sf_dir), '"_"', ["integer:quality"], ["integer:quality"], 700)
    return _numbered(_shown(found, "doc_id"), [F.asc_nulls_first("quality"), F.col("doc_id")])


@registered("unsorted_limit", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts NULLS FIRST, event_id LIMIT 25")
def unsorted_limit(spark, sf_dir):
    return _shown(search.select(events(spark, sf_dir), "?event_type = :error", ["datetime:ts"], limit=25, arrival=[F.col("ts")]), "event_id")


@registered("unsorted_reverse", "SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM (SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts NULLS FIRST, event_id LIMIT 25)")
def unsorted_reverse(spark, sf_dir):
    found = search.select(events(spark, sf_dir), "?event_type = :error", ["datetime:ts"], limit=25, reverse=True, arrival=[F.col("ts")])
    return _numbered(_shown(found, "event_id"), [F.desc_nulls_last("ts"), F.desc_nulls_last("event_id")])


@registered("page_offset_limit", "SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts NULLS FIRST, event_id LIMIT 30 OFFSET 60")
def page_offset_limit(spark, sf_dir):
    return _shown(search.select(events(spark, sf_dir), "?event_type = :click", ["datetime:ts"], ["datetime:ts"]).offset(60).limit(30), "event_id")


searched("project_fields", events, "?user_id < 10", "event_id", "SELECT event_id, value, event_type FROM events WHERE user_id < 10", fields=["float:value", "literal:event_type", "text:unknown"])


# Index tables


def _document_words(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(values.tokens(F.col("text"))).alias("term"))


_WORDS = f"(SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)"


@registered("tokens", f"SELECT doc_id, len({_TOKENS})::INTEGER AS n, {_TOKENS}[1] AS first, {_TOKENS}[len({_TOKENS})] AS last FROM documents")
def tokens(spark, sf_dir):
    w = values.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n"), F.get(w, F.lit(0)).alias("first"), F.try_element_at(w, F.lit(-1)).alias("last"))


_SPOTS = f"(SELECT doc_id, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) - 1 AS spot FROM documents)"


@registered("postings_text", f"SELECT 'text:message' AS field, doc_id AS event_id, term, array_to_string(list_sort(list(spot)), ',') AS positions FROM {_SPOTS} GROUP BY ALL")
def postings_text(spark, sf_dir):
    bound = documents(spark, sf_dir)
    rows = postings.of_field(bound.events(), FieldId.of("text:message"), F.col("`text:message`"))
    return rows.select("field", "event_id", "term", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@registered("postings_hostname", f"SELECT 'hostname:host' AS field, page_id AS event_id, term, array_to_string(list_sort(list(spot)), ',') AS positions FROM (SELECT page_id, unnest(string_split(lower({_HOST}), '.')) AS term, generate_subscripts(string_split(lower({_HOST}), '.'), 1) - 1 AS spot FROM pages) WHERE term <> '' GROUP BY ALL")
def postings_hostname(spark, sf_dir):
    bound = pages(spark, sf_dir)
    rows = postings.of_field(bound.events(), FieldId.of("hostname:host"), F.col("`hostname:host`"))
    return rows.select("field", "event_id", "term", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@registered("postings_integer", "SELECT 'integer:user_id' AS field, event_id, user_id AS term_long FROM events WHERE user_id IS NOT NULL")
def postings_integer(spark, sf_dir):
    bound = events(spark, sf_dir)
    return postings.of_field(bound.events(), FieldId.of("integer:user_id"), F.col("`integer:user_id`")).select("field", "event_id", "term_long")


@registered("forward_index", f"SELECT doc_id AS event_id, 'text:message' AS field, array_to_string(list_sort(list(DISTINCT term)), ' ') AS terms FROM {_WORDS} GROUP BY doc_id")
def forward_index(spark, sf_dir):
    bound = documents(spark, sf_dir)
    rows = postings.forward(postings.of_field(bound.events(), FieldId.of("text:message"), F.col("`text:message`")))
    return rows.select("event_id", "field", F.array_join("terms", " ").alias("terms"))


# Statistics


@registered("term_count", f"SELECT count(*) AS term_count FROM {_WORDS}")
def term_count(spark, sf_dir):
    return stats.term_count(_document_words(spark, sf_dir))


@registered("term_frequency", f"SELECT term, count(*) AS frequency FROM {_WORDS} GROUP BY term")
def term_frequency(spark, sf_dir):
    return stats.term_frequency(_document_words(spark, sf_dir))


@registered("cardinality_exact", f"SELECT count(DISTINCT term) AS cardinality FROM {_WORDS}")
def cardinality_exact(spark, sf_dir):
    return stats.cardinality_exact(_document_words(spark, sf_dir))


@registered("cardinality_hll", f"SELECT true AS within FROM {_WORDS} LIMIT 1")
def cardinality_hll(spark, sf_dir):
    words = _document_words(spark, sf_dir)
    by_half = stats.hll(words.withColumn("half", F.pmod("doc_id", F.lit(2))), ["half"])
    found = stats.hll_cardinality(stats.merge_hll(by_half))
    return found.crossJoin(stats.cardinality_exact(words).toDF("exact")).select((F.abs(F.col("cardinality") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within"))


@registered("cms_within_bound", f"SELECT count(DISTINCT term) AS terms, true AS never_below, true AS mostly_within FROM {_WORDS}")
def cms_within_bound(spark, sf_dir):
    words = _document_words(spark, sf_dir)
    exact = stats.term_frequency(words)
    both = stats.estimate_frequency(stats.count_min(words), exact).join(exact, "term")
    over = F.col("estimate") - F.col("frequency")
    total = F.sum("frequency")
    rows = both.agg(F.count(F.lit(1)).alias("terms"), F.min(over).alias("least"), total.alias("total"), F.collect_list(F.lit(1)).alias("_")).drop("_")
    limit = both.crossJoin(rows.select("total")).agg(F.avg((over <= stats.CMS_EPS * F.col("total")).cast("double")).alias("share"))
    return rows.crossJoin(limit).select("terms", (F.col("least") >= 0).alias("never_below"), (F.col("share") >= stats.CMS_CONFIDENCE).alias("mostly_within"))


@registered("bloom_no_false_negatives", f"SELECT count(DISTINCT term) AS terms, true AS every_member FROM {_WORDS}")
def bloom_no_false_negatives(spark, sf_dir):
    words = _document_words(spark, sf_dir)
    bits = stats.bloom_bits(1 << 17)
    found = stats.maybe_member(stats.bloom(words, bits), words, bits)
    return found.agg(F.count(F.lit(1)).alias("terms"), F.bool_and("member").alias("every_member"))


@registered("minhash_self", "SELECT 1.0::DOUBLE AS similarity")
def minhash_self(spark, sf_dir):
    words = _document_words(spark, sf_dir)
    halves = stats.minhash(words.withColumn("half", F.pmod("doc_id", F.lit(2))), ["half"])
    return stats.similarity(stats.minhash(words), stats.merge_minhash(halves))


# Syslog


def _frames(spark, sf_dir) -> DataFrame:
    """A message of each event, with its type as tag on every fifth, its values declared and sent."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    pri = F.pmod("event_id", F.lit(192)).cast("string")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    tag = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('[source@42785 tag="'), kind, F.lit('" tag="all"]'))).otherwise("")
    schema = F.lit('[schema@42785 u="integer:user_id" v="float:value" k="literal:kind"]')
    sent = F.concat(F.lit('[values@42785 u="'), user, F.lit('" v="'), F.col("value").cast("string"), F.lit('" k="'), kind, F.lit('" x="lost"]'))
    note = F.concat(F.lit('[note@1 q="a\\"b\\\\c\\]d\\e" q="'), user, F.lit('"]'))
    frame = F.concat(F.lit("<"), pri, F.lit(">1 "), time, F.lit("Z h"), user, F.lit(".example.com app - "), kind, F.lit(" "), tag, schema, sent, note, F.lit(" user "), user, F.lit(" did "), kind)
    rows = read(spark, sf_dir, "events").where("event_type is not null and user_id is not null and value is not null and ts is not null")
    return rows.select(F.pmod("user_id", F.lit(10)).cast("string").alias("conn_id"), F.col("event_id").alias("seq"), frame.alias("frame"))


_SENT = "FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL"
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@registered("syslog_parse", f"SELECT event_id AS seq, 1 AS version, date_trunc('millisecond', ts) AS timestamp, 'h' || user_id || '.example.com' AS origin, 'app' AS appname, '-' AS procid, event_type AS msgid, 'user ' || user_id || ' did ' || event_type AS message {_SENT}")
def syslog_parse(spark, sf_dir):
    return syslog.parse(_frames(spark, sf_dir)).where("valid").select("seq", "version", "timestamp", "origin", "appname", "procid", "msgid", "message")


@registered("syslog_pri", f"SELECT event_id AS seq, {_LIST(syslog.FACILITIES)}[(event_id % 192) // 8 + 1] AS facility, {_LIST(syslog.SEVERITIES)}[event_id % 8 + 1] AS severity {_SENT}")
def syslog_pri(spark, sf_dir):
    return syslog.parse(_frames(spark, sf_dir)).select("seq", "facility", "severity")


@registered("syslog_sd", f"SELECT event_id AS seq, 'a\"b\\c]d\\e' AS first, user_id::VARCHAR AS second, (CASE WHEN event_id % 5 = 0 THEN 4 ELSE 3 END)::INTEGER AS elements {_SENT}")
def syslog_sd(spark, sf_dir):
    note = F.element_at(F.element_at("sd", "note@1"), "q")
    return syslog.parse(_frames(spark, sf_dir)).select("seq", F.get(note, F.lit(0)).alias("first"), F.get(note, F.lit(1)).alias("second"), F.size("sd").alias("elements"))


@registered("syslog_typed_values", f"SELECT event_id AS seq, user_id, value, event_type AS kind, 1 AS literals {_SENT}")
def syslog_typed_values(spark, sf_dir):
    typed = syslog.typed_values(F.col("sd"), syslog.declared(F.col("sd")))
    by = {k.value: c for k, c in typed.items()}
    return syslog.parse(_frames(spark, sf_dir)).select("seq", F.element_at(by["integer"], "user_id").alias("user_id"), F.element_at(by["float"], "value").alias("value"), F.element_at(by["literal"], "kind").alias("kind"), F.size(by["literal"]).alias("literals"))


@registered("syslog_ipv6_value", "SELECT event_id AS seq, '20010DB8000000000000' || printf('%04X', user_id % 65536) || '0000' || printf('%04X', event_id % 65536) AS peer, '00000000000000000000FFFF0A0000' || printf('%02X', user_id % 256) AS old FROM events WHERE user_id IS NOT NULL")
def syslog_ipv6_value(spark, sf_dir):
    user, ident = F.col("user_id"), F.col("event_id")
    group = lambda c: F.lower(F.hex(F.pmod(c, F.lit(65536))))
    peer = F.concat(F.lit("2001:DB8::"), group(user), F.lit(":0:"), group(ident))
    old = F.concat(F.lit("::ffff:10.0.0."), F.pmod(user, F.lit(256)).cast("string"))
    frame = F.concat(F.lit('<13>1 - h app - - [schema@42785 p="address:peer" o="address:old"][values@42785 p="'), peer, F.lit('" o="'), old, F.lit('"] m'))
    rows = read(spark, sf_dir, "events").where("user_id is not null").select(ident.alias("seq"), frame.alias("frame"))
    parsed = syslog.parse(rows)
    typed = syslog.typed_values(F.col("sd"), syslog.declared(F.col("sd")))
    own = next(c for k, c in typed.items() if k.value == "address")
    return parsed.select("seq", F.hex(F.element_at(own, "peer")).alias("peer"), F.hex(F.element_at(own, "old")).alias("old"))


@registered("udp_frames", f"SELECT event_id AS seq, 0::BIGINT AS n, event_type AS msgid, user_id {_SENT}")
def udp_frames(spark, sf_dir):
    """Each datagram is one frame."""
    chunks = _frames(spark, sf_dir).select("conn_id", "seq", F.col("frame").cast("binary").alias("data"))
    found = syslog.parse(ingest.frames(chunks, framed=False)).where("valid")
    typed = {k.value: c for k, c in syslog.typed_values(F.col("sd"), F.col("schema")).items()}
    return found.select("seq", "n", "msgid", F.element_at(typed["integer"], "user_id").alias("user_id"))


@registered("sticky_tags", f"SELECT event_id AS seq, coalesce(last_value(CASE WHEN event_id % 5 = 0 THEN event_type || ',all' END IGNORE NULLS) OVER (PARTITION BY user_id % 10 ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS tags {_SENT}")
def sticky_tags(spark, sf_dir):
    return ingest.sticky_tags(syslog.parse(_frames(spark, sf_dir))).select("seq", F.array_join("tags", ",").alias("tags"))


@registered("syslog_version_0", "SELECT event_id, 'user' AS facility, 'notice' AS severity, date_trunc('millisecond', ts) AS timestamp, 'host' || user_id AS origin, 'did ' || event_type AS message FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL")
def syslog_version_0(spark, sf_dir):
    frame = F.concat(F.lit("<13>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00 host"), F.col("user_id"), F.lit(" did "), F.col("event_type"))
    rows = read(spark, sf_dir, "events").select("event_id", frame.alias("frame")).where("frame is not null")
    return syslog.parse(rows).where("valid and version = 0").select("event_id", "facility", "severity", "timestamp", "origin", "message")


# Routes

_STORES = ["errors", "all", "sales"]


def _routed(name: str, routes: list[routing.Route], sql_case: str) -> None:
    @registered(name, f"SELECT event_id, unnest({sql_case}) AS target FROM events")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chain = routing.RoutingChain(list(routes))
        to = chain.targets(F.array("event_type"), _STORES)
        return read(spark, sf_dir, "events").select("event_id", F.explode(to).alias("target"))


_ERROR = routing.Route("errors", (routing.MatchTag("error"),), routing.Store(("errors", "all")))
_REST = routing.Route("rest", (routing.MatchAll(),), routing.Store(("all",)))
_routed("route_first_match", [_ERROR, routing.Route("again", (routing.MatchTag("click"), routing.MatchTag("error")), routing.Store(("sales",))), _REST], "CASE event_type WHEN 'error' THEN ['errors', 'all'] WHEN 'click' THEN ['sales'] ELSE ['all'] END")
_routed("route_none_stops", [_ERROR, routing.Route("stop", (routing.MatchNone(),), routing.StoreAll()), _REST], "CASE event_type WHEN 'error' THEN ['errors', 'all'] ELSE []::VARCHAR[] END")
_routed("route_store_all", [routing.Route("buy", (routing.MatchTag("purchase"),), routing.StoreAll())], "CASE event_type WHEN 'purchase' THEN ['errors', 'all', 'sales'] ELSE []::VARCHAR[] END")
_routed("route_drop", [routing.Route("views", (routing.MatchTag("view"),), routing.Drop()), _REST], "CASE event_type WHEN 'view' THEN []::VARCHAR[] ELSE ['all'] END")
_routed("route_unknown_target", [routing.Route("odd", (routing.MatchAll(),), routing.Store(("nowhere", "sales", "sales")))], "['sales']")


# Streams


@registered("stream_ingest_equals_batch", f"SELECT event_id AS seq, event_type AS msgid, user_id, value, coalesce(last_value(CASE WHEN event_id % 5 = 0 THEN event_type || ',all' END IGNORE NULLS) OVER (PARTITION BY user_id % 10 ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS tags {_SENT}")
def stream_ingest_equals_batch(spark, sf_dir):
    """The stateful framing and sticky state over octet-counted chunks of each connection."""
    framed = F.concat(F.octet_length("frame").cast("string"), F.lit(" "), F.col("frame")).cast("binary")
    chunks = _frames(spark, sf_dir).select("conn_id", "seq", framed.alias("data"))
    found = syslog.parse(ingest.frames(chunks)).where("valid")
    typed = {k.value: c for k, c in syslog.typed_values(F.col("sd"), F.col("schema")).items()}
    return found.select("seq", "msgid", F.element_at(typed["integer"], "user_id").alias("user_id"), F.element_at(typed["float"], "value").alias("value"), F.array_join("tags", ",").alias("tags"))


# Encoding


@registered("event_json", """SELECT event_id, '[' || event_id || ',{"event_type":{"LITERAL":"' || event_type || '"},"user_id":{"INTEGER":' || user_id || '},"ts":{"DATETIME":' || epoch_ms(date_trunc('millisecond', ts)) || '}}]' AS body FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL""")
def event_json_query(spark, sf_dir):
    bound = events(spark, sf_dir)
    rows = bound.table.where("event_type is not null and user_id is not null and ts is not null")
    return rows.select("event_id", event_json(bound, [FieldId.of(f) for f in ("literal:event_type", "integer:user_id", "datetime:ts")]).alias("body"))


_DIGIT = f"substr('{values.KEY_ALPHABET}', ((event_id >> {{0}}) & 63)::INTEGER + 1, 1)"
_KEY = " || ".join([f"CASE WHEN event_id >> {6 * i} > 0 THEN {_DIGIT.format(6 * i)} ELSE '' END" for i in range(5, 0, -1)] + [_DIGIT.format(0)])


@registered("short_key", f"SELECT event_id, {_KEY} AS short_key FROM events")
def short_key(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", values.short_key_column(F.col("event_id")).alias("short_key"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large error events, oldest first."""
    return _shown(search.select(events(spark, sf_dir), "?event_type = :error AND ?value > 100.0", sort_by=["datetime:ts"], limit=100), "event_id")
