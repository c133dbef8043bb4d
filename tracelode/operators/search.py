"""Substring and indicator search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.predicate import _named, line_of

#: Indicators up to which expressions test them one by one; more go into one automaton.
MANY = 64


def search_rows(
    df: DataFrame, query: str, column: int | str | None = None, ignore_case: bool = False, limit: int | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Rows that hold ``query``: anywhere, or in one column.

    In a column, ``ignore_case`` asks for equality of the whole cell; without
    it for a substring.  An empty query matches nothing.
    """
    if not query:
        return df.limit(0)
    if column is None:
        line = line_of(df)
        hit = F.contains(F.lower(line), F.lit(query.lower())) if ignore_case else F.contains(line, F.lit(query))
    else:
        cell = _named(df, column)[0].cast("string")
        hit = F.lower(cell) == query.lower() if ignore_case else F.contains(cell, F.lit(query))
    return _cut(df.where(hit), limit, order)


def _cut(df: DataFrame, limit: int | None, order: Sequence[str]) -> DataFrame:
    if order:
        df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def overlaps_itself(query: str) -> bool:
    return any(query[:k] == query[-k:] for k in range(1, len(query)))


def occurrence_count(text: Column, query: str, ignore_case: bool = True) -> Column:
    """How often ``query`` occurs, overlapping occurrences included."""
    if not query:
        return F.lit(0)
    if ignore_case:
        text, query = F.lower(text), query.lower()
    if overlaps_itself(query):
        return F.regexp_count(text, F.lit(f"(?=\\Q{query}\\E)"))
    # lengths, as nothing overlaps: no regular expression
    return ((F.length(text) - F.length(F.replace(text, F.lit(query)))) / F.lit(len(query))).cast("int")


def occurrences(df: DataFrame, text_col: str, query: str, keep: Sequence[str], ignore_case: bool = True) -> DataFrame:
    """One row per occurrence: the ``keep`` columns and ``offset``, code points from 0.

    Overlapping occurrences are found.  Rows without a hit never leave the JVM;
    the offsets of the others are found in Arrow batches, in time linear in the text.
    """
    if not query:
        return df.select(*keep, F.lit(0).cast("long").alias("offset")).limit(0)
    text = F.lower(F.col(text_col)) if ignore_case else F.col(text_col)
    query = query.lower() if ignore_case else query
    rows = df.where(F.contains(text, F.lit(query))).select(*keep, text.cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, offset = [], []
            for k, t in enumerate(b.column("__text")):
                t = t.as_py()
                at = t.find(query)
                while at >= 0:
                    owner.append(k)
                    offset.append(at)
                    at = t.find(query, at + 1)
            taken = b.drop_columns(["__text"]).take(pa.array(owner, pa.int64()))
            yield pa.record_batch([*taken.columns, pa.array(offset, pa.int64())], [*taken.schema.names, "offset"])

    return rows.mapInArrow(run, schema)


def distinct_rows(df: DataFrame, text_col: str, query: str, row_col: str, limit: int | None = None) -> DataFrame:
    """The rows that hold ``query`` without case, each once, in row order."""
    hit = F.contains(F.lower(F.col(text_col)), F.lit(query.lower())) if query else F.lit(False)
    return _cut(df.where(hit).select(row_col).distinct(), limit, [row_col])


def dataset_search(df: DataFrame, query: str, limit: int, file_col: str = "file_name", row_col: str = "row_idx", line_col: str = "line", ignore_case: bool = False) -> DataFrame:
    """(file_name, row_index, content) of matching lines over all files, by file and row, cut at ``limit``."""
    line = F.lower(F.col(line_col)) if ignore_case else F.col(line_col)
    hit = F.contains(line, F.lit(query.lower() if ignore_case else query)) if query else F.lit(False)
    rows = df.where(hit).select(F.col(file_col).alias("file_name"), F.col(row_col).alias("row_index"), F.col(line_col).alias("content"))
    return rows.orderBy("file_name", "row_index").limit(limit)


def indicator_list(lines: Sequence[str], comments: bool = False) -> list[str]:
    """Indicators of a list file: trimmed, without blanks and, if asked, without ``#`` lines."""
    out = [s for line in lines if (s := line.strip())]
    return [s for s in out if not s.startswith("#")] if comments else out


def indicators(df: DataFrame, text_col: str, patterns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(indicator, keep..., hits) for every row that holds an indicator, without case; overlapping hits count.

    All indicators are tested in one pass over the rows: up to ``MANY`` as
    expressions, a longer list as one automaton in Arrow batches.
    """
    wanted = list(dict.fromkeys(p for p in patterns if p))
    low = F.lower(F.col(text_col))
    if len(wanted) > MANY:
        return _many(df, low, wanted, keep)
    found = F.array_compact(
        F.array(
            *[
                F.when(F.contains(low, F.lit(p.lower())), F.struct(F.lit(p).alias("indicator"), occurrence_count(F.col(text_col), p).alias("hits")))
                for p in wanted
            ]
        )
    )
    return df.select(*keep, F.explode(found).alias("f")).select("f.indicator", *keep, F.col("f.hits").cast("long").alias("hits"))


@lru_cache(maxsize=1)
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    scan = ahocorasick.Automaton()
    spelled: dict[str, list[int]] = {}
    for k, p in enumerate(patterns):
        spelled.setdefault(p.lower(), []).append(k)
    for low, ks in spelled.items():
        scan.add_word(low, ks)
    scan.make_automaton()
    return scan


def _many(df: DataFrame, low: Column, wanted: list[str], keep: Sequence[str]) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(tuple(wanted))  # the caller's own list
    rows = df.select(*keep, low.alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value
        scan = _automaton(names)
        for b in batches:
            owner, which, hits = [], [], []
            for k, t in enumerate(b.column("__text")):
                counts = Counter(n for _, ns in scan.iter(t.as_py() or "") for n in ns)
                owner += [k] * len(counts)
                which += [names[n] for n in counts]
                hits += counts.values()
            taken = b.drop_columns(["__text"]).take(pa.array(owner, pa.int64()))
            yield pa.record_batch([pa.array(which, pa.string()), *taken.columns, pa.array(hits, pa.int64())], ["indicator", *taken.schema.names, "hits"])

    return rows.mapInArrow(run, f"indicator string, {kept}, hits bigint")


def viewer(df: DataFrame, query: str, text_col: str, row_col: str = "row_idx", sample: int = 10, limit: int = 100_000) -> DataFrame:
    """The viewer's box: digits jump to that row; any other text samples the rows that hold it."""
    if query.strip().isdigit():
        return df.where(F.col(row_col) == int(query.strip()))
    hits = distinct_rows(df, text_col, query, row_col, limit)
    return df.join(hits, row_col, "left_semi").orderBy(row_col).limit(sample)
