"""Line deduplication by pairwise alignment.

Documents that share a block are paired, each pair's lines are aligned by
patience diff, and common blocks are deleted from the later document (the one
of the larger id).  A block is a run of lines that is contiguous in both
documents; it is deleted if it has at least ``min_lines`` lines, or is a line
of at least ``min_words`` words.  Blank lines belong to the run around them.
Blocks that the alignment leaves out, as they stand in another order or more
than once, are then found by their windows and deleted too.

Pairing: every block is made of windows, which are ``min_lines`` adjacent lines
or one line of ``min_words`` words.  Each holder of a window is paired with the
window's first holder.  That is exact, in however many documents a block is:
the first holder has the window, and a pair deletes all windows it shares, so
the result is that of all pairs.  Pairs grow in proportion to the windows, and
no group of copies is expanded into all its pairs.

Only hashes travel: a line or window is 16 bytes, a pair two arrays of them.

Defined results: a null or empty text has no lines; lines are compared
without outer white space; a row with a null id is neither cut nor a reason to
cut; rows that share an id are one document, which never loses a line to
itself, but each is cut by its own text; very long texts are read whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def split_lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {v: j for j, v in enumerate(b[b0:b1], b0) if once_b[v] == 1}
        both = [(i, at_b[v]) for i, v in enumerate(a[a0:a1], a0) if v in at_b and once_a[v] == 1]
        anchors = _increasing(both)
        if not anchors:
            continue
        out += anchors
        for (i, j), (x, y) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((i + 1, x, j + 1, y))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by first place, that also increases in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back[k] = ends[p - 1] if p else -1
        tails[p : p + 1], ends[p : p + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def windows(lines: list[bytes], words: list[int], min_lines: int, min_words: int) -> set[bytes]:
    """The keys of the windows of hashed lines."""
    many = (b"".join(lines[k : k + min_lines]) for k in range(len(lines) - min_lines + 1))
    return {xxhash.xxh3_128_digest(m) for m in many} | {h for h, n in zip(lines, words, strict=True) if n >= min_words}


def common_blocks(earlier: list[bytes], later: list[bytes], words: list[int], min_lines: int, min_words: int) -> list[tuple[int, int]]:
    """Ranges [start, end) of the later document's lines that common blocks cover.

    Takes hashes of lines that are not blank; ``words``: of the later document's lines.
    """
    out, run = [], []
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            s, e = run[0][1], run[-1][1] + 1
            if e - s >= min_lines:
                out.append((s, e))
            else:
                out += [(k, k + 1) for k in range(s, e) if words[k] >= min_words]
            run = []
        run.append((i, j))
    done = {k for s, e in out for k in range(s, e)}
    if len(done) < len(later):
        # blocks out of order or repeated, which no alignment holds
        runs = {tuple(earlier[k : k + min_lines]) for k in range(len(earlier) - min_lines + 1)}
        out += [(k, k + min_lines) for k in range(len(later) - min_lines + 1) if tuple(later[k : k + min_lines]) in runs]
        held = set(earlier)
        out += [(k, k + 1) for k, h in enumerate(later) if k not in done and words[k] >= min_words and h in held]
    return out


def _sketches(rows: DataFrame) -> DataFrame:
    """(id, key, lines, words): hash and word count of each line that is not blank; key: the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                lines, words = [], []
                for t in b.column(2):
                    kept = [s for x in split_lines(t.as_py() or b"") if (s := x.strip())]
                    lines.append([xxhash.xxh3_128_digest(s) for s in kept])
                    words.append([len(s.split()) for s in kept])
                yield pa.record_batch([b.column(0), b.column(1), pa.array(lines, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int32()))], ["id", "key", "lines", "words"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, key bigint, lines array<binary>, words array<int>")


def overlapping_pairs(sketches: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(first, first_key, later, later_key): texts to align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                keys, owner = [], []
                for k, (lines, words) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                    mine = windows(lines.as_py(), words.as_py(), min_lines, min_words)
                    keys += mine
                    owner += [k] * len(mine)
                at = pa.array(owner, pa.int64())
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(keys, pa.binary())], ["id", "key", "window"])

    kind = sketches.schema["id"].dataType.simpleString()
    held = sketches.select("id", "key", "lines", "words").mapInArrow(run, f"id {kind}, key bigint, window binary")
    first = F.min(F.struct("id", "key")).alias("first")
    # written, so that both sides of the join are dealt anew and the holders of a frequent window can be split
    stats = materialize(held.groupBy("window").agg(first, F.count("*").alias("df")).where("df > 1").drop("df"), "line-windows", release=True)
    both = held.join(stats, "window").where("id > first.id")
    return both.select(F.col("first.id").alias("first"), F.col("first.key").alias("first_key"), F.col("id").alias("later"), F.col("key").alias("later_key")).distinct()


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_lines: int = 2,
    min_words: int = 8,
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed (of lines not blank), n_partners, kept (the remaining text)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    named = rows.where("id IS NOT NULL AND text IS NOT NULL")
    # rows of one id and text have one sketch
    sketches = materialize(_sketches(named).dropDuplicates(["id", "key"]), "line-sketches")
    pairs = overlapping_pairs(sketches, min_lines, min_words)
    early = sketches.select(F.col("id").alias("eid"), F.col("key").alias("ekey"), F.col("lines").alias("early"))
    late = sketches.select(F.col("id").alias("lid"), F.col("key").alias("lkey"), F.col("lines").alias("late"), "words")
    aligned = (
        pairs.join(late, F.expr("later = lid AND later_key = lkey"))
        .join(early, F.expr("first = eid AND first_key = ekey"))
        .select(F.col("later").alias("id"), F.col("later_key").alias("key"), "early", "late", "words")
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                gone = []
                for e, lt, w in zip(*(b.column(k) for k in (2, 3, 4)), strict=True):
                    blocks = common_blocks(e.as_py(), lt.as_py(), w.as_py(), min_lines, min_words)
                    gone.append(sorted({k for s, t in blocks for k in range(s, t)}))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int32()))], ["id", "key", "gone"])

    cuts = aligned.mapInArrow(align, f"id {kind}, key bigint, gone array<int>").where(F.size("gone") > 0)
    cuts = cuts.groupBy(F.col("id").alias("cid"), F.col("key").alias("ckey")).agg(
        F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.count("*").alias("n_partners")
    )
    both = rows.join(cuts, F.expr("id = cid AND key = ckey"), "left").select(
        "id", "text", "gone", F.coalesce("n_partners", F.lit(0)).alias("n_partners")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                n_lines, n_removed, kept = [], [], []
                for t, g in zip(b.column(1), b.column(2), strict=True):
                    lines = split_lines(t.as_py() or b"")
                    full = [k for k, x in enumerate(lines) if x.strip()]
                    drop = {full[k] for k in g.values.to_pylist()} if g.is_valid else set()
                    n_lines.append(len(full))
                    n_removed.append(len(drop))
                    kept.append(b"\n".join(x for k, x in enumerate(lines) if k not in drop))
                yield pa.record_batch(
                    [b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), b.column(3), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_lines", "n_removed", "n_partners", "kept"],
                )

    return both.mapInArrow(cut, f"doc_id {kind}, n_lines bigint, n_removed bigint, n_partners bigint, kept string")
