"""RFC 5424 messages to typed columns: the header with native expressions, structured data in one pass over Arrow batches.

A message without VERSION ("version 0") has only a time, a host and text. The nil time is consumed; nil APP-NAME, PROCID
and MSGID stay ``-``. In structured data ``\\"``, ``\\\\`` and ``\\]`` lose their backslash, any other keeps it; repeated
parameters accumulate; of repeated element ids the last counts; elements may have no parameters.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bound, coerced
from ..types import FieldType

#: Names of the facilities (0-23) and severities (0-7), ids of the elements that describe events.
FACILITIES = ["kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "auth", "auth", "cron", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7"]
SEVERITIES = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]
SCHEMA_ID, VALUES_ID, SOURCE_ID = "schema@42785", "values@42785", "source@42785"

_TIME = r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)"
_PARAM = r'[^\s="\]]++="(?:[^"\\\]]++|\\.)*+"'
_ELEMENT = r'\[[^\s="\]]++(?: ++[^\s="\]]++="(?:[^"\\\]]++|\\.)*+")*+ *+\]'
_FULL = rf"(?s)^<(0|[1-9]\d{{0,2}})>([1-9]\d{{0,2}}) ({_TIME}|-) (\S++) (\S++) (\S++) (\S++) (-|(?:{_ELEMENT})++)(?: (.*))?$"
_DATA = rf"(?s)^(?:{_ELEMENT})++"
_BRIEF = rf"(?s)^<(0|[1-9]\d{{0,2}})>({_TIME}|-) (\S++)(?: (.*))?$"
_BOM = "\ufeff"
EMPTY_SD = "map<string,map<string,array<string>>>"
#: A parameter or the begin of an element; an id is not followed by ``=``. White space is ASCII, as in the patterns above.
_TOKEN = re.compile(r'([^\s="\]]++)="((?:[^"\\\]]++|\\.)*+)"|\[([^\s="\]]++)', re.ASCII | re.DOTALL)
_ESCAPE = re.compile(r'\\(["\\\]])')
#: Longer structured data stays out of Python, which holds ten thousand rows of it.
_LONG = 32_768


def pri(value: Column) -> tuple[Column, Column]:
    """(facility name, severity name); null where the number is over 191."""
    n = value.try_cast("int")
    return F.get(F.array(*map(F.lit, FACILITIES)), F.floor(n / 8).cast("int")), F.when(n < 192, F.get(F.array(*map(F.lit, SEVERITIES)), n % 8))


def utc(text: Column) -> Column:
    """A zone-less UTC timestamp, to the millisecond, whatever the session's zone."""
    millis = F.unix_millis(F.upper(text).try_cast("timestamp"))
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), millis.cast("decimal(18,0)") / F.lit(1000).cast("decimal(18,0)"))
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + seconds


def _maps(texts: pa.Array) -> pa.Array:
    """EMPTY_SD's type from the texts of structured data that the pattern has accepted; empty for nil and null."""
    rows, ids, params, names, lists, values = [0], [], [0], [], [0], []
    for text in texts.to_pylist():
        if text and text != "-":
            elements: dict[str, dict[str, list[str]]] = {}
            for name, value, ident in _TOKEN.findall(text):
                if ident:
                    elements.pop(ident, None)
                    own = elements[ident] = {}
                else:
                    own.setdefault(name, []).append(_ESCAPE.sub(r"\1", value) if "\\" in value else value)
            for ident, own in elements.items():
                ids.append(ident)
                names += own
                for several in own.values():
                    values += several
                    lists.append(len(values))
                params.append(len(names))
        rows.append(len(ids))
    offsets, texts_of = lambda at: pa.array(at, pa.int32()), lambda them: pa.array(them, pa.string())
    inner = pa.MapArray.from_arrays(offsets(params), texts_of(names), pa.ListArray.from_arrays(offsets(lists), texts_of(values)))
    return pa.MapArray.from_arrays(offsets(rows), texts_of(ids), inner)


def structured_data(text: Column) -> Column:
    """``map<id, map<name, array<value>>>``; empty for nil."""

    @F.arrow_udf(EMPTY_SD)
    def parsed(texts: pa.Array) -> pa.Array:
        return _maps(texts)

    short = F.length(text) <= _LONG
    return F.when(F.length(text) > _LONG, _native(text)).otherwise(parsed(F.when(short, text)))


def _native(text: Column) -> Column:
    """The same without Python."""
    unescaped = lambda v: F.when(v.contains("\\"), F.regexp_replace(v, r'\\(["\\\]])', "$1")).otherwise(v)

    def pair(whole: Column) -> Column:
        """``name="value"`` in its parts: a name has no ``=``."""
        name = F.substring_index(whole, '="', 1)
        return bound(name, lambda n: F.struct(n.alias("n"), unescaped(F.substring(whole, F.length(n) + 3, F.length(whole) - F.length(n) - 3)).alias("v")))

    def params(pairs: Column) -> Column:
        names = F.array_distinct(pairs["n"])
        of = lambda n: F.transform(F.filter(pairs, lambda p: p["n"] == n), lambda p: p["v"])
        repeated = bound(names, lambda names: F.map_from_arrays(names, F.transform(names, of)))
        return F.when(F.size(names) == F.size(pairs), F.map_from_arrays(pairs["n"], F.transform(pairs, lambda p: F.array(p["v"])))).otherwise(repeated)

    def element(e: Column) -> Column:
        pairs = F.transform(F.regexp_extract_all(e, F.lit("(?s)" + _PARAM), F.lit(0)), pair)
        ident = F.substring_index(F.substring_index(F.substring(e, 2, 1 << 30), " ", 1), "]", 1)
        return F.struct(ident.alias("id"), bound(pairs, params).alias("params"))

    def last(elements: Column) -> Column:
        repeated = F.filter(elements, lambda x, i: ~F.exists(F.slice(elements, i + 2, F.size(elements)), lambda y: y["id"] == x["id"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(elements["id"])) == F.size(elements), elements).otherwise(repeated))

    return bound(F.transform(F.regexp_extract_all(text, F.lit("(?s)" + _ELEMENT), F.lit(0)), element), last)


def parse(frames: DataFrame, column: str = "frame") -> DataFrame:
    """``frames`` with valid, version, facility, severity, timestamp, origin, appname, procid, msgid, sd, message.

    Each message meets the pattern once; what it matched is then cut at its single spaces, as no part of the header has
    one. The kind of a message comes from a generator, as Spark copies a filter on other columns below their projection,
    and would match twice.
    """
    raw = F.col(column).cast("string")
    text = F.when(raw.startswith(_BOM), F.substring(raw, 2, 1 << 30)).otherwise(raw)
    rows = frames.select("*", text.alias("__text"))
    text, kind, part = F.col("__text"), F.col("__kind"), lambda i: F.get("__parts", F.lit(i))
    rows = rows.select("*", F.explode_outer(F.array(F.when(text.rlike(_FULL), 1).when(text.rlike(_BRIEF), 0))).alias("__kind"))
    rows = rows.select("*", F.when(kind == 1, F.split(text, " ", 7)).when(kind == 0, F.split(text, " ", 3)).alias("__parts"))
    rows = rows.select("*", F.when(kind == 1, F.when(part(6).startswith("-"), "-").otherwise(F.regexp_extract(part(6), _DATA, 0))).alias("__sd"))
    full, brief = kind == 1, kind == 0
    pick = lambda i, j: F.when(full, i).when(brief, j)
    number = F.when(kind.isNotNull(), F.substring_index(F.substring(text, 2, 4), ">", 1))
    facility, severity = pri(number)
    behind = F.substring_index(part(0), ">", -1)
    time = pick(part(1), behind)
    after = F.length("__sd")
    sd = structured_data(F.col("__sd"))
    body = pick(F.when(F.substring(part(6), after + 1, F.lit(1)) == " ", F.substring(part(6), after + 2, F.lit(1 << 30))), part(2))
    body = F.when(body.startswith(_BOM), F.substring(body, 2, 1 << 30)).otherwise(body)
    return rows.select(
        "*",
        F.coalesce(number.cast("int") < 192, F.lit(False)).alias("valid"),
        pick(behind.try_cast("int"), F.lit(0)).alias("version"),
        facility.alias("facility"),
        severity.alias("severity"),
        utc(F.when(time != "-", time)).alias("timestamp"),
        F.lower(pick(part(2), F.rtrim(part(1), F.lit("\r\n")))).alias("origin"),
        F.when(full, part(3)).alias("appname"),
        F.when(full, part(4)).alias("procid"),
        F.when(full, part(5)).alias("msgid"),
        sd.alias("sd"),
        F.when(body != "", body).alias("message"),
    ).drop("__text", "__kind", "__parts", "__sd")


#: The fields every message has, by type.
STANDARD = {"origin": FieldType.HOSTNAME, "timestamp": FieldType.DATETIME, "facility": FieldType.LITERAL, "severity": FieldType.LITERAL, "appname": FieldType.LITERAL, "procid": FieldType.LITERAL, "msgid": FieldType.LITERAL, "message": FieldType.TEXT}


def declared(sd: Column) -> Column:
    """``map<short name, type:name>`` of a message's schema element, or null."""
    return F.transform_values(F.element_at(sd, SCHEMA_ID), lambda _, v: F.get(v, F.lit(0)))


def tags(sd: Column) -> Column:
    """Tags of a message's source element, or null where it has none (they stay as they were)."""
    source = F.element_at(sd, SOURCE_ID)
    return F.when(source.isNotNull(), F.array_distinct(F.coalesce(F.element_at(source, "tag"), F.array().cast("array<string>"))))


def typed_values(sd: Column, schema: Column) -> dict[FieldType, Column]:
    """For each type ``map<name, value>`` of the values whose short names ``schema`` declares."""
    values = F.coalesce(F.element_at(sd, VALUES_ID), F.create_map().cast("map<string,array<string>>"))
    pairs = bound(schema, lambda known: F.transform(F.map_entries(values), lambda e: F.struct(F.element_at(known, e["key"]).alias("spec"), F.get(e["value"], F.lit(0)).alias("raw"))))
    return {kind: bound(_of_kind(pairs, kind), _first_of_names) for kind in FieldType}


def _first_of_names(named: Column) -> Column:
    """A map of (name, value) pairs; of several pairs with one name (two short names may be declared for it) the first."""
    first = F.filter(named, lambda x, i: ~F.exists(F.slice(named, 1, i), lambda y: y["name"] == x["name"]))
    return F.map_from_entries(F.when(F.size(F.array_distinct(named["name"])) == F.size(named), named).otherwise(first))


def _of_kind(pairs: Column, kind: FieldType) -> Column:
    own = F.filter(pairs, lambda p: F.lower(F.substring_index(p["spec"], ":", 1)) == kind.value)
    named = F.transform(own, lambda p: F.struct(F.substring(p["spec"], F.instr(p["spec"], ":") + 1, F.lit(1 << 30)).alias("name"), coerced(kind, p["raw"]).alias("value")))
    return F.filter(named, lambda p: p["value"].isNotNull())
