"""Columns for the typed values: all built from native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FieldType

#: The alphabet of short field keys.
KEY_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"


#: The years 1 to 9999 in epoch milliseconds; other date-times are null.
MILLIS = (-62_135_596_800_000, 253_402_300_799_999)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Lower-cased words between runs of white space; empty for blank texts, null for null."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def labels(host: Column) -> Column:
    return F.filter(F.split(F.lower(host), r"\."), lambda t: t != "")


def host_key(host: Column) -> Column:
    """Sort key of hostnames: labels from the top-level one."""
    return F.reverse(labels(host))


def ipv4(text: Column) -> Column:
    """16 address bytes from dotted text, or null."""
    parts = F.split(text, r"\.")
    octet = lambda x: F.lpad(F.hex(x.try_cast("int")), 2, "0")
    fine = text.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
    return F.when(fine, F.unhex(F.concat(F.lit("00000000000000000000FFFF"), F.array_join(F.transform(parts, octet), ""))))


_GROUPS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"


def ipv6(text: Column) -> Column:
    """16 address bytes from IPv6 text, or null. One ``::`` stands for one or more zero groups, the last two groups may be dotted."""
    dotted = F.hex(ipv4(F.regexp_extract(text, r":([0-9.]+)$", 1)))
    plain = F.when(text.contains("."), bound(dotted, lambda h: F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.substring(h, 25, 4), F.lit(":"), F.substring(h, 29, 4)))).otherwise(text)

    def padded(plain: Column) -> Column:
        groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
        short = plain.contains("::")
        left, right = groups(F.substring_index(plain, "::", 1)), groups(F.when(short, F.substring_index(plain, "::", -1)).otherwise(""))

        def filled(sides: Column) -> Column:
            missing = F.lit(8) - F.size(sides["l"]) - F.size(sides["r"])
            fits = F.when(short, missing >= 1).otherwise(missing == 0)
            whole = F.concat(sides["l"], F.array_repeat(F.lit("0"), missing), sides["r"])
            return F.when(fits, F.unhex(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))

        fine = F.coalesce(plain.rlike(rf"^(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?$") & plain.contains(":"), F.lit(False))
        return F.when(fine, bound(F.struct(left.alias("l"), right.alias("r")), filled))

    return bound(plain, padded)


def ipv4_of_number(n: Column) -> Column:
    """16 address bytes of an IPv4 address given as a number."""
    return F.unhex(F.concat(F.lit("00000000000000000000FFFF"), F.lpad(F.hex(n.cast("long")), 8, "0")))


def address_text(value: Column) -> Column:
    """Dotted text of mapped IPv4 addresses, eight hex groups of others."""
    h = F.hex(value)
    byte = lambda i: F.conv(F.substring(h, i * 2 + 1, 2), 16, 10)
    dotted = F.concat_ws(".", *[byte(i) for i in range(12, 16)])
    groups = F.concat_ws(":", *[F.lower(F.substring(h, i * 4 + 1, 4)) for i in range(8)])
    return F.when(h.startswith("00000000000000000000FFFF"), dotted).otherwise(F.when(value.isNotNull(), groups))


def coerced(kind: FieldType, raw: Column) -> Column:
    """A typed value from text as it comes from a stream; null where it doesn't parse.

    Date-times are epoch milliseconds, addresses dotted IPv4 text or IPv6 text.
    """
    if kind is FieldType.INTEGER:
        return raw.try_cast("long")
    if kind is FieldType.FLOAT:
        return raw.try_cast("double")
    if kind is FieldType.DATETIME:
        millis = raw.try_cast("long")
        return F.when(millis.between(*MILLIS), F.timestamp_millis(millis)).cast("timestamp_ntz")
    if kind is FieldType.ADDRESS:
        return bound(raw, lambda text: F.when(text.contains(":"), ipv6(text)).otherwise(ipv4(text)))
    return F.lower(raw) if kind is FieldType.HOSTNAME else raw


def short_key(index: int) -> str:
    """Compact name of the ``index``-th field: base 64 in KEY_ALPHABET, without leading zeros."""
    out = KEY_ALPHABET[index & 63]
    while index := index >> 6:
        out = KEY_ALPHABET[index & 63] + out
    return out


def short_key_column(index: Column) -> Column:
    digit = lambda i: F.substring(F.lit(KEY_ALPHABET), F.shiftright(index, 6 * i).bitwiseAND(F.lit(63)).cast("int") + 1, F.lit(1))
    parts = [F.when(F.shiftright(index, 6 * i) > 0, digit(i)).otherwise("") for i in range(5, 0, -1)]
    return F.concat(*parts, digit(0))
