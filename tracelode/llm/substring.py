r"""Substring deduplication with super-k-mer partitioning.

A window is ``window`` consecutive words.  Its minimiser is the least hash
among its word ``gram``-grams, so equal windows have equal minimisers.  A run
of consecutive windows with one minimiser (a super-k-mer) travels as one
packed string to the minimiser's bucket, where the windows are sorted and
counted by their full text: each learns the smallest document that holds it.

What travels is cut down without losing anything: a minimiser that one
document alone has cannot hold a shared window, so its runs stay at home; equal
packed strings are merged map-side before they move (a group of copies becomes
one row); and a bucket with over ``crowd`` different strings (the edges of a
passage that very many documents share) is dealt anew, each window to a bucket
of its own hash.  No bucket therefore holds more than ``crowd`` strings.  A run
is cut after ``_RUN`` windows, so a text of few different words, which may have
one minimiser throughout, does not travel as one string.

A word is removed if a window that covers it also starts in a document with a
smaller id.  Windows are judged on the input, not on what is left.

Defined results: a null text has no words; texts of fewer than ``window``
words lose nothing; a row with a null id loses nothing and takes nothing from
others; rows that share an id are one document, so they do not cut each other,
but each loses what its own text has in common with a smaller document; very
long texts are read whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the rolling hashes, and their inverses modulo 2^64.
_R, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_R_INV, _Q_INV = pow(_R, -1, 1 << 64), pow(_Q, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Windows that a run holds at most.
_RUN = 64


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Hashes of the slices [start, end) of ``values``, by prefix sums."""
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(base, len(values)))])
    return _mix((prefix[ends] - prefix[starts]) * _power(inverse, len(values) + 1)[starts])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word, in order."""
    raw = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate([[0], (~_BLANK[raw]).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return _rolling(raw.astype(np.uint64) + np.uint64(1), starts, ends, _R, _R_INV)


def runs(text: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The super-k-mers of a text: minimiser, first window, number of windows."""
    words = word_hashes(text)
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(len(words) - gram + 1)
    least = _rolling(words, at, at + gram, _Q, _Q_INV)
    width, done = window - gram + 1, 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: -(width - done)], least[width - done :])
    cuts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    sizes = np.diff(np.append(cuts, n))
    if (sizes > _RUN).any():
        parts = -(-sizes // _RUN)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts = np.repeat(cuts, parts) + _RUN * within
        sizes = np.diff(np.append(cuts, n))
    return least[cuts].view(np.int64), cuts, sizes


def window_key(packed: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "big", signed=True)


def _picks(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, m): the minimisers that each document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.unique(runs(t.as_py() or b"", window, gram)[0]) for t in b.column(1)]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each])))
            yield pa.record_batch([ids, pa.array(np.concatenate([np.empty(0, np.int64), *each]))], ["id", "m"])

    return rows.mapInArrow(run, f"id {_kind(rows)}, m bigint")


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def _super_kmers(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, key, bucket, packed, start) of the runs whose minimiser is in the row's ``ms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, bucket, packed, start = [], [], [], []
            for k, (text, ms) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                m, first, count = runs(text.as_py() or b"", window, gram)
                hit = np.flatnonzero(np.isin(m, ms.values.to_numpy()))
                words = (text.as_py() or b"").split()
                for h in hit.tolist():
                    s = int(first[h])
                    owner.append(k)
                    bucket.append(int(m[h]))
                    packed.append(b" ".join(words[s : s + int(count[h]) + window - 1]))
                    start.append(s)
            yield pa.record_batch(
                [*(b.column(k).take(pa.array(owner, pa.int64())) for k in (0, 1)), pa.array(bucket, pa.int64()), pa.array(packed, pa.binary()), pa.array(start, pa.int32())],
                ["id", "key", "bucket", "packed", "start"],
            )

    return rows.mapInArrow(run, f"id {_kind(rows)}, key bigint, bucket bigint, packed binary, start int")


def _cut(occurrences: DataFrame, window: int) -> DataFrame:
    """The same windows, each travelling alone to a bucket of its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                owner, packed, start = [], [], []
                for k, (text, s) in enumerate(zip(part.column("packed").to_pylist(), part.column("start").to_pylist(), strict=True)):
                    words = text.split(b" ")
                    n = len(words) - window + 1
                    owner += [k] * n
                    packed += [b" ".join(words[i : i + window]) for i in range(n)]
                    start += range(s, s + n)
                yield pa.record_batch(
                    [*(part.column(c).take(pa.array(owner, pa.int64())) for c in ("id", "key")), pa.array([window_key(p) for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(start, pa.int32())],
                    ["id", "key", "bucket", "packed", "start"],
                )

    return occurrences.mapInArrow(run, f"id {_kind(occurrences)}, key bigint, bucket bigint, packed binary, start int")


def _count(distinct: DataFrame, window: int) -> DataFrame:
    """(bucket, packed, firsts): for each window of a packed string the smallest id that holds it.

    Strings of which no document loses anything are left out.
    """
    kind = distinct.schema["lo"].dataType.simpleString()

    def bucket_rows(group: list[tuple]) -> Iterator[tuple]:
        if len(group) == 1:
            b, packed, lo, hi = group[0]
            if lo != hi:
                yield b, packed, [lo] * (packed.count(b" ") + 2 - window)
            return
        windows, owner = [], []
        for k, (_, packed, _, _) in enumerate(group):
            words = packed.split(b" ")
            mine = [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]
            windows += mine
            owner += [k] * len(mine)
        firsts, seen, least = [None] * len(windows), None, None
        # equal windows meet in order of id, so the first of each run is the smallest
        for i in sorted(range(len(windows)), key=lambda i: (windows[i], group[owner[i]][2])):
            if windows[i] != seen:
                seen, least = windows[i], group[owner[i]][2]
            firsts[i] = least
        at = 0
        for b, packed, lo, hi in group:
            mine = firsts[at : at + packed.count(b" ") + 2 - window]
            at += len(mine)
            if lo != hi or any(f != lo for f in mine):
                yield b, packed, mine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out, size, id_type = [], [], 0, None

        def batch():
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.record_batch(
                [pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.binary()), pa.array(list(cols[2]), pa.list_(id_type))],
                ["bucket", "packed", "firsts"],
            )

        for b in batches:
            id_type = b.schema.field("lo").type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][0] != row[0]:
                    out += bucket_rows(group)
                    group = []
                    if len(out) > 2000:
                        yield batch()
                        out = []
                group.append(row)
        if group:
            out += bucket_rows(group)
        if id_type is not None:
            yield batch()

    dealt = distinct.select("bucket", "packed", "lo", "hi").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"bucket bigint, packed binary, firsts array<{kind}>")


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, crowd: int) -> DataFrame:
    """(id, key, windows): the numbers of a text's windows that also start in a smaller document; key: the text's."""
    rows = _rows(docs, id_col, text_col).where("id IS NOT NULL AND text IS NOT NULL")
    picks = materialize(_picks(rows.select("id", "text"), window, gram), "minimisers", release=True)
    shared = picks.groupBy("m").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    wanted = picks.join(shared.select("m"), "m").groupBy("id").agg(F.collect_list("m").alias("ms"))
    chosen = rows.join(wanted.withColumnRenamed("id", "wid"), F.col("id") == F.col("wid")).select("id", "key", "text", "ms")
    occurrences = materialize(_super_kmers(chosen, window, gram), "super-kmers", release=True)
    distinct = _merged(occurrences)
    crowded = distinct.groupBy("bucket").count().where(F.col("count") > crowd).select(F.col("bucket").alias("cb"))
    crowded = materialize(crowded, "crowded", release=True)
    if not crowded.isEmpty():
        same = F.col("bucket") == F.col("cb")
        calm = occurrences.join(crowded, same, "left_anti")
        packed = occurrences.join(crowded, same, "left_semi")
        occurrences = materialize(calm.unionByName(_cut(packed, window)), "super-kmers-cut", release=True)
        distinct = _merged(occurrences)
    firsts = _count(distinct, window).select(F.col("bucket").alias("fb"), F.col("packed").alias("fp"), "firsts")
    lost = occurrences.join(firsts, (F.col("bucket") == F.col("fb")) & (F.col("packed") == F.col("fp"))).select(
        "id",
        "key",
        F.filter(
            F.transform("firsts", lambda f, i: F.when(f < F.col("id"), F.col("start") + i)), lambda x: x.isNotNull()
        ).alias("w"),
    )
    return lost.where(F.size("w") > 0).groupBy("id", "key").agg(F.flatten(F.collect_list("w")).alias("windows"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): the key tells the texts of one id apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


def _merged(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("bucket", "packed").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    gram: int = 8,
    crowd: int = 2000,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed (word ranges), kept (the remaining text).

    ``kept`` joins the kept words by one space.
    """
    # written first, so that its shuffles are gone before the texts are dealt
    lost = materialize(repeated_windows(docs, id_col, text_col, window, gram, crowd), "lost-windows", release=True)
    lost = lost.withColumnsRenamed({"id": "lid", "key": "lkey"})
    rows = _rows(docs, id_col, text_col)
    both = rows.join(lost, F.expr("id = lid AND key = lkey"), "left").select("id", "text", "windows")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                n_words, n_removed, removed, kept = [], [], [], []
                for text, gone in zip(b.column(1), b.column(2), strict=True):
                    words = (text.as_py() or b"").split()
                    ranges = []
                    if gone.is_valid:
                        first = np.unique(gone.values.to_numpy())
                        cut = np.flatnonzero(np.diff(first) > window) + 1
                        starts, ends = first[np.append(0, cut)], first[np.append(cut - 1, len(first) - 1)] + window
                        ranges = list(zip(starts.tolist(), ends.tolist(), strict=True))
                    n_words.append(len(words))
                    n_removed.append(sum(e - s for s, e in ranges))
                    removed.append([{"start": s, "end": e} for s, e in ranges])
                    for s, e in reversed(ranges):
                        del words[s:e]
                    kept.append(b" ".join(words))
                yield pa.record_batch(
                    [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, spans), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "removed", "kept"],
                )

    return both.mapInArrow(
        run, f"doc_id {_kind(rows)}, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept string"
    )
