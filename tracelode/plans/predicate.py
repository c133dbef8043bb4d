"""The filter language: text to a Catalyst expression.

    or   := and (OR and)*
    and  := term (AND term)*
    term := '(' or ')' | $N op literal
    op   := = == != > >= < <=          also: && for AND, || for OR

``$N`` is a column by its place, from 0.  Logic has two values: a comparison
that cannot be made (no such column, null, text that is no number) is false,
also for ``!=``.  Numbers compare with tolerance 1e-9 for = and !=; text
compares with = and != only, ASCII letters without case.

Leaves over numeric columns compare the bare column where that gives the same
rows, so that the filter reaches the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import date_key, number, strict_number

TOLERANCE = 1e-9
_TOKEN = re.compile(
    r"""\s*(?:(?P<col>\$[0-9]+)|(?P<num>-?[0-9]+(?:\.[0-9]*)?)|(?P<str>'[^']*'|"[^"]*")"""
    r"""|(?P<op>==|!=|>=|<=|=|>|<)|(?P<and>&&|and\b)|(?P<or>\|\||or\b)|(?P<paren>[()]))""",
    re.IGNORECASE,
)


class FilterError(ValueError):
    """The filter text does not follow the grammar."""


class Token(NamedTuple):
    kind: str
    text: str


@dataclass(frozen=True)
class Compare:
    column: int
    op: str
    value: float | str


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


Node = Compare | Both | Either


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected character in filter at {at}: {text[at:at + 10]!r}")
        out.append(Token(m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str) -> Node:
    tokens = tokenize(text)
    if not tokens:
        raise FilterError("empty filter")
    node, at = _chain(tokens, 0, "or")
    if at < len(tokens):
        raise FilterError(f"unexpected {tokens[at].text!r} after the filter")
    return node


def _chain(tokens: list[Token], at: int, joint: str) -> tuple[Node, int]:
    """A sequence joined by OR, of sequences joined by AND, of terms."""
    below = (lambda k: _chain(tokens, k, "and")) if joint == "or" else (lambda k: _term(tokens, k))
    node, at = below(at)
    parts = [node]
    while at < len(tokens) and tokens[at].kind == joint:
        node, at = below(at + 1)
        parts.append(node)
    if len(parts) == 1:
        return parts[0], at
    return (Either if joint == "or" else Both)(tuple(parts)), at


def _term(tokens: list[Token], at: int) -> tuple[Node, int]:
    take = lambda k: tokens[k] if k < len(tokens) else Token("end", "the end")
    first = take(at)
    if first == ("paren", "("):
        node, at = _chain(tokens, at + 1, "or")
        if take(at) != ("paren", ")"):
            raise FilterError(f"expected ')' before {take(at).text!r}")
        return node, at + 1
    op, literal = take(at + 1), take(at + 2)
    if first.kind != "col" or op.kind != "op" or literal.kind not in ("num", "str"):
        raise FilterError(f"expected a comparison '$N op literal' at {first.text!r}")
    value = float(literal.text) if literal.kind == "num" else literal.text[1:-1]
    return Compare(int(first.text[1:]), "=" if op.text == "==" else op.text, value), at + 3


def _leaf(df: DataFrame, c: Compare) -> Column:
    if c.column >= len(df.columns):
        return F.lit(False)
    name, kind = df.dtypes[c.column]
    col = F.col(f"`{name}`")
    if isinstance(c.value, str):
        text, want = F.lower(F.trim(col.cast("string"))), F.lit(c.value.lower())
        return {"=": text == want, "!=": text != want}.get(c.op, F.lit(False))
    x = strict_number(col) if kind == "string" else col
    n = c.value
    if kind == "string" or kind in ("double", "float"):
        finite = ~F.isnan(x)
    else:
        finite = F.lit(True)
    if c.op == "=":
        # bounds first: they can be pushed to the scan
        return (x >= n - 2 * TOLERANCE) & (x <= n + 2 * TOLERANCE) & (F.abs(x - F.lit(n)) < TOLERANCE)
    if c.op == "!=":
        return (F.abs(x.cast("double") - F.lit(n)) >= TOLERANCE) & finite
    return {">": (x > n) & finite, ">=": (x >= n) & finite, "<": x < n, "<=": x <= n}[c.op]


def to_column(df: DataFrame, node: Node, top: bool = True) -> Column:
    """The node over the columns of ``df``, null read as false."""
    if isinstance(node, Compare):
        leaf = _leaf(df, node)
    else:
        parts = [to_column(df, p, top=True) for p in node.parts]
        leaf = parts[0]
        for p in parts[1:]:
            leaf = leaf | p if isinstance(node, Either) else leaf & p
    # AND and OR are monotone, so a null row is dropped by a filter either way; no coalesce, which would stop pushdown
    return leaf if top else F.coalesce(leaf, F.lit(False))


def where(df: DataFrame, text: str) -> DataFrame:
    """Rows that meet a filter text."""
    return df.where(to_column(df, parse(text)))


def flag(df: DataFrame, text: str) -> Column:
    """The filter as a true or false column."""
    return F.coalesce(to_column(df, parse(text)), F.lit(False))


def _named(df: DataFrame, column: int | str) -> tuple[Column, str]:
    """A column by place or by name (trimmed, without case), with its type."""
    names = df.columns
    if isinstance(column, str):
        same = [k for k, n in enumerate(names) if n.strip().lower() == column.strip().lower()]
        if not same:
            raise KeyError(f"no column {column!r}")
        column = same[0]
    if column >= len(names):
        raise KeyError(f"no column {column}")
    return F.col(f"`{names[column]}`"), df.dtypes[column][1]


def in_range(df: DataFrame, column: int | str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose number lies in [low, high]; either side may be open; rows without a number go."""
    col, kind = _named(df, column)
    x = number(kind, col) if kind == "string" else col
    out = df.where(x.isNotNull())
    if low is not None:
        out = out.where(x >= F.lit(low))
    if high is not None:
        out = out.where(x <= F.lit(high))
    return out


def in_dates(df: DataFrame, column: int | str, start: int | str | None = None, end: int | str | None = None) -> DataFrame:
    """Rows whose date lies in [start, end], given as YYYYMMDD or YYYY-MM-DD; rows without a date go."""
    col, kind = _named(df, column)
    bound = lambda d: None if d is None else int(str(d).replace("-", ""))
    start, end = bound(start), bound(end)
    iso = lambda d: f"{d // 10000:04d}-{d // 100 % 100:02d}-{d % 100:02d}"
    if kind in ("date", "timestamp", "timestamp_ntz"):  # on the bare column, for pushdown
        out = df.where(col.isNotNull())
        if start is not None:
            out = out.where(col >= F.lit(iso(start)).cast(kind))
        if end is not None:
            out = out.where(col < F.date_add(F.lit(iso(end)).cast("date"), 1).cast(kind))
        return out
    key = date_key(col, kind)
    out = df.where(key.isNotNull())
    if start is not None:
        out = out.where(key >= start)
    if end is not None:
        out = out.where(key <= end)
    return out


def contains_text(df: DataFrame, column: int | str, needle: str) -> DataFrame:
    """Rows whose cell holds ``needle``, without case; an empty needle matches nothing."""
    col, _ = _named(df, column)
    return df.where(F.contains(F.lower(col.cast("string")), F.lit(needle.lower())) if needle else F.lit(False))


def matches(df: DataFrame, pattern: str, sep: str = ",") -> DataFrame:
    """Rows whose line (all cells joined by ``sep``) holds a match of a regular expression."""
    return df.where(line_of(df, sep).rlike(pattern))


def line_of(df: DataFrame, sep: str = ",") -> Column:
    """A row as one line of text; null cells are empty."""
    return F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])


def select_rows(
    df: DataFrame,
    filter_text: str | None = None,
    number_range: tuple | None = None,
    date_range: tuple | None = None,
    text: tuple | None = None,
    regex: str | None = None,
    sep: str = ",",
) -> DataFrame:
    """Rows that meet every given predicate."""
    if regex:
        df = matches(df, regex, sep)
    if number_range:
        df = in_range(df, *number_range)
    if date_range:
        df = in_dates(df, *date_range)
    if text:
        df = contains_text(df, *text)
    return where(df, filter_text) if filter_text else df
