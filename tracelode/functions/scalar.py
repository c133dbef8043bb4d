"""Scalar functions as Column builders; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest numeric prefix: sign, digits, at most one point, no exponent.
_PREFIX = r"^[\x20\t\r\n\f]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"
#: A trailing type letter, which the cast would accept and a number does not have.
_SUFFIX = r"(?i)[0-9.][dfl]$"


def unquote(c: Column) -> Column:
    """Trimmed, without one pair of outer double quotes."""
    return F.regexp_replace(F.trim(c), '^"(.*)"$', "$1")


def numeric_prefix(c: Column) -> Column:
    """The number that a cell starts with, after one outer pair of quotes; null if none.

    ``12abc`` is 12, ``1,234`` is 1 and ``1e5`` is 1.
    """
    inner = F.regexp_replace(c.cast("string"), '^"(.*)"$', "$1")
    return F.nullif(F.regexp_extract(inner, _PREFIX, 1), F.lit("")).try_cast("double")


def strict_number(c: Column) -> Column:
    """The number that a whole trimmed cell spells; null if it spells none."""
    s = F.trim(c.cast("string"))
    return F.when(~s.rlike(_SUFFIX), s.try_cast("double"))


def number(df_type: str, c: Column, strict: bool = False) -> Column:
    """A column as a double: a cast for numeric types, parsing for text."""
    if df_type in ("string", "binary"):
        return strict_number(c) if strict else numeric_prefix(c)
    return c.cast("double")


def date_key(c: Column, df_type: str = "string") -> Column:
    """YYYYMMDD as an integer out of a ``YYYY-MM-DD`` prefix, a date or a timestamp; null if there is none."""
    if df_type in ("date", "timestamp", "timestamp_ntz"):
        return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)
    s = c.cast("string")
    part = lambda k: F.regexp_extract(s, r"^([0-9]{4})-([0-9]{2})-([0-9]{2})", k).try_cast("int")
    return F.when(part(2).between(1, 12) & part(3).between(1, 31), part(1) * 10000 + part(2) * 100 + part(3))


def looks_like_ip(c: Column) -> Column:
    """Three dots, or two colons or more, beside three hex digits or more."""
    dots = F.regexp_count(c, F.lit(r"\."))
    colons = F.regexp_count(c, F.lit(":"))
    hexes = F.regexp_count(c, F.lit("[0-9A-Fa-f]"))
    return F.coalesce(((dots == 3) | (colons >= 2)) & (hexes >= 3), F.lit(False))


def looks_like_mac(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"), F.lit(False))


def content_hash(c: Column) -> Column:
    """SHA-256 in hex, the content digest of this engine."""
    return F.sha2(c.cast("binary"), 256)


def ipv4_value(ip: Column) -> Column:
    """A dotted quad as an integer."""
    octet = lambda k: F.split_part(ip, F.lit("."), F.lit(k)).try_cast("bigint")
    return octet(1) * (1 << 24) + octet(2) * (1 << 16) + octet(3) * (1 << 8) + octet(4)


def is_private_ip(ip: Column) -> Column:
    """RFC 1918, loopback and link-local for v4; loopback for v6."""
    v = ipv4_value(ip)
    within = [
        v.between(0x0A000000, 0x0AFFFFFF),
        v.between(0xAC100000, 0xAC1FFFFF),
        v.between(0xC0A80000, 0xC0A8FFFF),
        v.between(0x7F000000, 0x7FFFFFFF),
        v.between(0xA9FE0000, 0xA9FEFFFF),
    ]
    some = within[0]
    for w in within[1:]:
        some = some | w
    return F.when(F.contains(ip, F.lit(":")), ip == "::1").otherwise(F.coalesce(some, F.lit(False)))


def ip_sort_key(ip: Column) -> Column:
    """Text by which v4 addresses sort by value, before all v6 ones."""
    v4 = F.concat(F.lit("4"), F.lpad(ipv4_value(ip).cast("string"), 10, "0"))
    return F.when(F.contains(ip, F.lit(":")), F.concat(F.lit("6"), F.lower(ip))).otherwise(v4)


def flag_emoji(code: Column) -> Column:
    """The regional-indicator pair of a two-letter country code; empty otherwise."""
    up = F.upper(code)
    # U+1F1E6.. in UTF-8 are F0 9F 87 A6..; A is 0x41
    one = lambda k: F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substring(up, k, 1)) + (0xA6 - 0x41)))
    return F.when(up.rlike("^[A-Z]{2}$"), F.decode(F.unhex(F.concat(one(1), one(2))), "UTF-8")).otherwise("")


def compact(c: Column) -> Column:
    """1.2B, 3.4M, 5.6K, else two decimals; ``-`` if not finite."""
    v = c.cast("double")
    size = F.abs(v)
    bad = v.isNull() | F.isnan(v) | (size == float("inf"))
    scaled = lambda by, unit: F.format_string(f"%.1f{unit}", v / F.lit(by))
    return (
        F.when(bad, "-")
        .when(size >= 1e9, scaled(1e9, "B"))
        .when(size >= 1e6, scaled(1e6, "M"))
        .when(size >= 1e3, scaled(1e3, "K"))
        .otherwise(F.format_string("%.2f", v))
    )


def noise_share(latin1: Column, start: Column, size: Column, reach: int = 16) -> Column:
    """True where over 35 % of the bytes within ``reach`` of a span are not printable.

    ``latin1`` holds one character for each byte; ``start`` counts from 0.
    Spans of two bytes or fewer are always noise.
    """
    first = F.greatest(start - reach, F.lit(0))
    window = F.substring(latin1, first + 1, start + size + reach - first)
    odd = F.length(F.regexp_replace(window, r"[\x20-\x7E\t\n\r]", ""))
    return (size <= 2) | (odd * 100 > F.length(window) * 35)
