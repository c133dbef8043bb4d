"""Benchmark decontamination with an Aho-Corasick automaton over normalised words.

A window is ``window`` consecutive words of a benchmark item; an item of fewer
words is one window.  One automaton whose alphabet is the benchmark's own
vocabulary scans each document once.  Its keys are the short items and, of the
longer ones, seeds: the runs of ``(window + 1) // 2`` words that start at every
multiple of that length.  Every window holds a whole seed, so where a seed
occurs the windows around it are looked up by their hash and compared word by
word.  The automaton has about one node for each benchmark word, not
``window`` of them.  Hits are mapped back to code point offsets of the
original text.

The automaton is built in each Python worker while the benchmark's texts stay
within ``max_block_bytes``.  A larger benchmark is dealt into blocks of that
size; the documents are scanned once for each block and the hits merged row by
row, so no item is ever left out and the results are those of one block.

Defined results: a null text has no words (n_words 0, never contaminated); an
item without words has no window; an item with a null id counts as item "";
repeated items count once; a very long text is scanned whole; a repeated
document row gives a repeated result, and rows that share an id are judged one
by one; empty tables give empty or all-clean results; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix, text_key

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes from 0x80, and blanks the rest.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _window_hashes(ids: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of the ``window`` word numbers from each start."""
    h = np.zeros(len(starts), np.uint64)
    for k in range(window):
        h = (h + ids[starts + k].astype(np.uint64) + np.uint64(1)) * _MULT
        h ^= h >> np.uint64(29)
    return h


class Automaton:
    """Windows of benchmark items over numbered words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.seed = window, (window + 1) // 2
        self.number: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        place = {item: k for k, item in enumerate(self.items)}
        short: dict[tuple[int, ...], set[int]] = {}
        seeds: set[tuple[int, ...]] = set()
        flat, starts, owners, base = [], [], [], 0
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            if not ids:
                continue
            if len(ids) < window:
                short.setdefault(tuple(ids), set()).add(place[item])
                continue
            seeds.update(tuple(ids[k : k + self.seed]) for k in range(0, len(ids) - self.seed + 1, self.seed))
            flat.append(np.array(ids, np.int32))
            starts.append(base + np.arange(len(ids) - window + 1))
            owners.append(np.full(len(ids) - window + 1, place[item], np.int32))
            base += len(ids)
        none = np.empty(0, np.int64)
        self.flat = np.concatenate([np.empty(0, np.int32), *flat])
        at, who = np.concatenate([none, *starts]), np.concatenate([np.empty(0, np.int32), *owners])
        h = _window_hashes(self.flat, at, window)
        order = np.lexsort((who, h))
        #: By hash: each occurrence of a window in the items, and its item.
        self.hashes, self.at, self.who = h[order], at[order], who[order]
        # a key's value: the number of its short item (from 1, 0: none) and whether it is a seed
        self.short = [sorted(v) for v in short.values()]
        self.scan = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        number_of = {key: n for n, key in enumerate(short, 1)}
        for key in seeds | set(short):
            self.scan.add_word(key, (len(key), number_of.get(key, 0), key in seeds))
        self.empty = not (seeds or short)
        if not self.empty:
            self.scan.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], bool]:
        """Merged word intervals [start, end) that windows cover, the items, and whether any window is a full one."""
        if self.empty or not words:
            return [], set(), False
        get = self.number.get
        ids = [get(w, 0) for w in words]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        seeds: list[int] = []
        for end, (size, n, seed) in self.scan.iter(tuple(ids)):
            if n:
                found.update(self.short[n - 1])
                spans.append((end + 1 - size, end + 1))
            if seed:
                seeds.append(end + 1 - size)
        full = self._full(np.array(ids, np.int32), np.array(seeds, np.int64), found) if seeds else []
        spans += [(s, s + self.window) for s in full]
        merged: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if merged and merged[-1][1] >= s:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, {self.items[k] for k in found}, bool(full)

    def _full(self, ids: np.ndarray, seeds: np.ndarray, found: set[int]) -> list[int]:
        """The starts of full windows around seeds; their items are added to ``found``."""
        reach = np.unique(seeds[:, None] - np.arange(self.window - self.seed + 1))
        reach = reach[(reach >= 0) & (reach + self.window <= len(ids))]
        h = _window_hashes(ids, reach, self.window)
        lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        out, seen = [], set()
        for s, a, b in zip(reach[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            mine = ids[s : s + self.window]
            if a in seen:  # the same hash before in this text: only its words are still to be compared
                same = bool((self.flat[self.at[a] : self.at[a] + self.window] == mine).all())
                if same:
                    out.append(s)
                    continue
            each = self.flat[self.at[a:b, None] + np.arange(self.window)]
            same = (each == mine).all(axis=1)
            if same.any():
                out.append(s)
                found.update(self.who[a:b][same].tolist())
            if same.all():
                seen.add(a)
        return out


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[str, bytes], ...], window: int) -> Automaton:
    return Automaton(list(items), window)


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original of word intervals."""
    raw = np.frombuffer(text, np.uint8)
    word = np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    starts, ends = point[np.flatnonzero(edge == 1)], point[np.flatnonzero(edge == -1)]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in spans]


_SCHEMA = "n_words bigint, hits array<struct<start:int,end:int>>, chars array<struct<start:int,end:int>>, items array<string>, full boolean"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(rows: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(tuple(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(held.value, window)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t in b.column(1):
                text = t.as_py() or b""
                words = words_of(text)
                spans, found, full = automaton.find(words)
                chars = offsets(text, spans) if spans else []
                for c, v in zip(
                    out,
                    (
                        len(words),
                        [{"start": s, "end": e} for s, e in spans],
                        [{"start": s, "end": e} for s, e in chars],
                        sorted(found),
                        full,
                    ),
                    strict=True,
                ):
                    c.append(v)
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array(out[0], pa.int64()),
                    pa.array(out[1], _SPANS),
                    pa.array(out[2], _SPANS),
                    pa.array(out[3], pa.list_(pa.string())),
                    pa.array(out[4], pa.bool_()),
                ],
                ["id", "n_words", "hits", "chars", "items", "full"],
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_SCHEMA}")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: int = 20,
    max_block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans, full, contaminated.

    ``spans`` are merged code point ranges of the original text; ``full``: some
    window of ``window`` words occurs; a document is contaminated if ``share``
    times its hit words reach its words.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    tests = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.col(item_text_col).cast("string").cast("binary").alias("text"),
    ).where("text IS NOT NULL")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a quarter more, as items differ in length
    blocks = 1 + int(1.25 * int(size)) // max_block_bytes if size > max_block_bytes else 1
    if blocks > 1:
        # a number for each row, written so that every scan sees the same one
        numbered = rows.select(F.struct(F.monotonically_increasing_id().alias("row"), "id").alias("id"), "text")
        rows = materialize(numbered, "leak-rows")
    parts = []
    for k in range(blocks):
        mine = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).distinct()
        parts.append(_scan(rows, sorted((r.item, bytes(r.text)) for r in mine.toLocalIterator()), window))
    if blocks == 1:
        found = parts[0]
    else:
        found = _merged(parts).withColumn("id", F.col("id.id"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "items", F.col("chars").alias("spans"), "full"
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _merged(parts: list[DataFrame]) -> DataFrame:
    """One row per document row out of its rows for each block of items; ``id`` holds the row's number."""

    def union_of(column: str):
        every = F.array_sort(F.flatten(F.collect_list(column)))
        last = lambda a: F.element_at(a, -1)
        none = F.array().cast("array<struct<start:int,end:int>>")
        join = lambda a, x: F.when(
            (F.size(a) > 0) & (F.coalesce(last(a)["end"], F.lit(-1)) >= x["start"]),
            F.concat(
                F.slice(a, 1, F.size(a) - 1),
                F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(a, F.array(x)))
        return F.aggregate(every, none, join).alias(column)

    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        union_of("hits"),
        union_of("chars"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("full").alias("full"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows that hold a benchmark passage; columns unchanged.

    A row goes if a full window occurs in its text, however long the text is,
    or if it is contaminated by shorter items.  Each row is judged by its own
    text, whatever its id: rows with null or repeated ids stay or go one by
    one, and repeated rows share their fate.  Null and wordless texts stay; an
    empty benchmark drops nothing; an empty table gives an empty result.
    """
    p = prefix(docs)
    keyed = docs.select(text_key(docs[text_col]).alias(p + "key"), docs[text_col].alias(p + "text"))
    leaks = find_leaks(keyed, benchmark, p + "key", p + "text").where("full OR contaminated")
    leaks = materialize(leaks.select(F.col("doc_id").alias(p + "key")).distinct(), "leaks")
    return docs.join(leaks, text_key(docs[text_col]) == leaks[p + "key"], "left_anti")
