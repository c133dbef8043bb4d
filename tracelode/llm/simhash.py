"""SimHash near-duplicate detection with pigeonhole blocks.

Fingerprints are 64-bit SimHashes of word shingles under XXH64.  Documents
with one fingerprint form a class, and only classes travel on.  Two
fingerprints that differ in at most ``distance`` bits agree on at least
``blocks - distance`` of ``blocks`` blocks, so each class goes to one bucket
for every choice of that many blocks; within a bucket the Hamming distances
are verified and a spanning forest of the links is kept (never all pairs).
With six blocks and distance 3 a bucket key holds 31 to 33 bits, so chance
meetings stay rare at billions of documents.  Bucket rows are 16 bytes for
each distinct fingerprint; copies do not reach them.  A crowded bucket is split
once more by the same rule on its remaining bits.

``near_dedup_filter`` looks for texts of similarity 0.8 over five-word shingles,
whose 64-bit fingerprints differ in about ten bits, too many for blocks of any
use.  It takes longer fingerprints, of as many blocks as make it likely that
such a pair shares one, and verifies the Hamming distance over 256 bits.

Defined results: a null or wordless text has fingerprint zero and is linked
like any other; a row with a null id gets its fingerprint and the component's
least id, which is null only if no member has an id; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, materialize, prefix, text_key

#: Words hashed at a time, so that a very long text needs little memory.
_CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one UTF-8 text, as a signed 64-bit integer."""
    words = (text or b"").lower().split()  # both ASCII only for bytes
    total = max(len(words) - shingle + 1, 1)
    if not words:
        return 0
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1]
        if len(words) < shingle:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        h = np.frombuffer(b"".join([digest(g, seed) for g in grams]), np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(h[:, k], minlength=256) @ _BITS
    return int(np.packbits(2 * counts > total).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _masks(blocks: int, distance: int) -> list[int]:
    """A signed mask for every choice of blocks that two linked fingerprints may agree on."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def differing(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """How many bits differ; unsigned, as the count of a negative number would be that of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


#: Distinct fingerprints of a bucket beyond which it is split again.
CROWD = 2048


def _signed(mask: int) -> np.int64:
    return np.int64(mask - (1 << 64) if mask >> 63 else mask)


def forest(fps: np.ndarray, distance: int, agreed: int = 0) -> tuple[list[int], list[int]]:
    """Links within one bucket of distinct fingerprints that connect all linked ones.

    Breadth first: what is reached leaves the candidates at once, so a dense
    bucket costs little more than its size.  A bucket over ``CROWD`` is split
    by pigeonhole again: its fingerprints are equal on the bits of ``agreed``,
    so of ``distance + 1`` parts of the others a linked pair has one in common.
    """
    a, b = [], []
    if len(fps) > CROWD:
        free = [k for k in range(64) if not agreed >> k & 1]
        if len(free) <= distance:
            return [int(fps[0])] * (len(fps) - 1), fps[1:].tolist()
        for part in range(distance + 1):
            mask = sum(1 << k for k in free[part :: distance + 1])
            key = fps & _signed(mask)
            order = np.argsort(key, kind="stable")
            mine, key = fps[order], key[order]
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
            starts = np.append(0, ends[:-1])
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                x, y = forest(mine[s:e], distance, agreed | mask)
                a += x
                b += y
        return a, b
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            top = queue.pop()
            near = differing(left, top) <= distance
            if near.any():
                got = left[near]
                a += [int(top)] * len(got)
                b += got.tolist()
                queue += list(got)
                left = left[~near]
    return a, b


def links(classes: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect all within ``distance`` bits."""
    keys = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("block"))
                for k, m in enumerate(_masks(blocks, distance))
            ]
        )
    )
    spread = classes.select("fp", keys.alias("key")).select("key.k", "key.block", "fp")
    # a bucket of one cannot hold a link
    dealt = spread.repartition("k", "block").sortWithinPartitions("k", "block")

    masks = [m % (1 << 64) for m in _masks(blocks, distance)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the bucket that may go on in the next batch
        now, parts = None, []

        def edges(buckets: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            a, b = [], []
            for k, fps in buckets:
                x, y = forest(fps, distance, masks[k])
                a += x
                b += y
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, block, fp = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (block[1:] != block[:-1])))
            ends = np.append(starts[1:], len(fp))
            done = []
            if now == (k[0], block[0]):
                parts.append(fp[: ends[0]])
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if parts:
                    done.append((int(now[0]), np.concatenate(parts)))
                for s, e in zip(starts[:-1], ends[:-1], strict=True):
                    if e - s > 1:
                        done.append((int(k[s]), fp[s:e]))
                now, parts = (k[-1], block[-1]), [fp[starts[-1] :]]
            yield edges(done)
        if parts:
            yield edges([(int(now[0]), np.concatenate(parts))])

    return dealt.mapInArrow(run, "u bigint, v bigint")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = 3,
    blocks: int = 6,
    shingle: int = 3,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least id reachable over links of at most ``distance`` differing bits.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    named = _named(classes, connected_components(links(classes.select("fp"), distance, blocks)))
    return fps.join(named, fps.fp == named.cfp).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Differing bits of the first ``_CHECKED`` that a link of the filter may have: 18.75 %, and what similar pairs have.
REACH, _CHECKED = 48, 256
#: The share of bits in which two documents of Jaccard similarity 0.8 differ, by the angle of their shingle vectors.
_MISS = float(np.arccos(2 * 0.8 / 1.8) / np.pi)
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def plan(n: int) -> tuple[int, int]:
    """(bits of a block, blocks) for ``n`` documents.

    A block has a bit for each doubling of ``n``, 20 at least, so chance
    meetings stay near one a document and block; there are so many blocks that
    a pair of similarity 0.8 shares one with a probability over 0.9.
    """
    width = max(20, int(n).bit_length())
    return width, int(np.ceil(np.log(0.08) / np.log1p(-((1 - _MISS) ** width))))


def wide_fingerprint(text: bytes | None, size: int, shingle: int = 5, seed: int = 42) -> bytes:
    """A SimHash of ``size`` bytes, from as many bits of a SplitMix64 stream seeded by each shingle's XXH64."""
    words = (text or b"").lower().split()
    total = max(len(words) - shingle + 1, 1)
    if not words:
        return bytes(size)
    steps = (np.arange(1, -(-size // 8) + 1, dtype=np.uint64) * _GAMMA)[None, :]
    counts = np.zeros(8 * 8 * steps.shape[1], np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, 255):  # so many that their bits add up in a byte
        part = words[at : at + 255 + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        z = np.array([digest(g, seed) for g in grams], np.uint64)[:, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > total).tobytes()[:size]


def _wide_fingerprints(rows: DataFrame, size: int, shingle: int) -> DataFrame:
    """(id, fp, wide) of rows (id, text); fp: a digest of the whole fingerprint, which names its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                wide = [wide_fingerprint(t.as_py(), size, shingle) for t in b.column(1)]
                fps = np.array([xxhash.xxh64_intdigest(w) for w in wide], np.uint64).view(np.int64)
                yield pa.record_batch([b.column(0), pa.array(fps), pa.array(wide, pa.binary())], ["id", "fp", "wide"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint, wide binary")


def reached(fps: np.ndarray, words: np.ndarray, reach: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one bucket; ``words``: the checked bits of each fingerprint."""
    a, b = [], []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            top = queue.pop()
            near = differing(words[left], words[top]).sum(axis=1) <= reach
            if near.any():
                got = left[near]
                a += [int(fps[top])] * len(got)
                b += fps[got].tolist()
                queue += got.tolist()
                left = left[~near]
    return a, b


def similar_links(classes: DataFrame, width: int, blocks: int, reach: int = REACH) -> DataFrame:
    """Edges (u, v) of classes (fp, wide) that share a block and differ in at most ``reach`` of the checked bits.

    They connect what all such links connect.
    """
    checked = _CHECKED // 64

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = (1 << np.arange(width - 1, -1, -1)).astype(np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                value = np.unpackbits(raw, axis=1)[:, : width * blocks].reshape(b.num_rows, blocks, width) @ places
                words = np.repeat(raw[:, : _CHECKED // 8].copy().view(np.int64), blocks, axis=0)
                columns = [np.tile(np.arange(blocks, dtype=np.int32), b.num_rows), value.ravel(), np.repeat(b.column(0).to_numpy(), blocks), *words.T]
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], ["k", "block", "fp", *(f"w{j}" for j in range(checked))])

    schema = "k int, block bigint, fp bigint, " + ", ".join(f"w{j} bigint" for j in range(checked))
    dealt = classes.select("fp", "wide").mapInArrow(spread, schema).repartition("k", "block").sortWithinPartitions("k", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the bucket that may go on in the next batch
        now, parts = None, []

        def edges(pairs: list[np.ndarray], buckets: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = (p.tolist() for p in pairs)
            for fps, words in buckets:
                x, y = reached(fps, words, reach)
                a += x
                b += y
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

        none = [np.empty(0, np.int64)] * 2
        for batch in batches:
            if not batch.num_rows:
                continue
            k, block, fp = (c.to_numpy() for c in batch.columns[:3])
            words = np.stack([c.to_numpy() for c in batch.columns[3:]], axis=1)
            starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (block[1:] != block[:-1])))
            ends = np.append(starts[1:], len(fp))
            done, pairs = [], none
            if now == (k[0], block[0]):
                parts.append((fp[: ends[0]], words[: ends[0]]))
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if parts:
                    done.append((np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts])))
                inner, size = starts[:-1], (ends - starts)[:-1]
                two = inner[size == 2]
                near = two[differing(words[two], words[two + 1]).sum(axis=1) <= reach]
                pairs = [fp[near], fp[near + 1]]
                done += [(fp[s : s + n], words[s : s + n]) for s, n in zip(inner[size > 2].tolist(), size[size > 2].tolist(), strict=True)]
                now, parts = (k[-1], block[-1]), [(fp[starts[-1] :], words[starts[-1] :])]
            yield edges(pairs, done)
        if parts:
            yield edges(none, [(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]))])

    return dealt.mapInArrow(run, "u bigint, v bigint")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, component_id, over links of similar texts (Jaccard 0.8 or more of five-word shingles).

    Two texts are linked if their fingerprints share a block (see ``plan``) and
    differ in at most ``reach`` of the first 256 bits.  That takes in nearly all
    pairs of similarity 0.8 that share a block, half of those of 0.7, and hardly any
    below 0.6; chance links are beyond reach.  component_id is the least id reachable.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    width, blocks = plan(rows.count())
    size = max(_CHECKED // 8, -(-width * blocks // 8))
    fps = materialize(_wide_fingerprints(rows, size, shingle), "similar-fp")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least"), F.first("wide").alias("wide")), "similar-classes", release=True)
    edges = materialize(similar_links(classes, width, blocks, reach).distinct(), "similar-links", release=True)
    named = _named(classes.select("fp", "least"), connected_components(edges))
    return fps.select("id", "fp").join(named, F.col("fp") == F.col("cfp")).select(F.col("id").alias("doc_id"), "component_id")


def _named(classes: DataFrame, components: DataFrame) -> DataFrame:
    """(cfp, component_id) of classes (fp, least): the least id of each one's component."""
    named = classes.join(components, classes.fp == components.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(roots, "component").select(F.col("fp").alias("cfp"), "component_id")


def near_dedup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``similar_groups``; columns unchanged.

    It is the row of the least id, null ids last; of several texts with that
    id in the component the one of the least digest, and one of repeated rows.
    Components, not ids, decide: rows of one id (or none) that lie in different
    components do not take each other's place.
    """
    p = prefix(docs)
    own = F.struct(docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id"), text_key(docs[text_col]).alias("key"))
    # a component is named by its least (no_id, id, key)
    keep = similar_groups(docs.select(own.alias("id"), docs[text_col].alias("text")), "id", "text").select("component_id").distinct()
    keep = keep.select(F.col("component_id.id").alias(p + "id"), F.col("component_id.key").alias(p + "key"))
    joined = docs.join(keep, docs[id_col].eqNullSafe(keep[p + "id"]) & (text_key(docs[text_col]) == keep[p + "key"]))
    once = W.partitionBy(p + "id", p + "key").orderBy(p + "key")
    return joined.withColumn(p + "n", F.row_number().over(once)).where(F.col(p + "n") == 1).select(*docs.columns)
