"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed over cells (source, language, topic).  Each cell gets a
sampling probability, at most 1, and the probabilities are raked: dimension by
dimension the cells of a value are scaled until the *expected sample*, caps
included, holds the value's target share, and so on in turn until all marginals
hold.  The expected sample is ``fraction`` of all tokens.  A document is taken
if a hash of its id and text, uniform in [0, 1), is below its probability: no
shuffle, and the same choice on every run.

Default targets temper the observed marginals: share to the power
``temperature``.  Explicit targets name shares per value; unnamed values share
the rest by their tempered sizes.  A value whose target exceeds all its tokens
is taken whole and the others fill up in proportion.  ``residual`` is the
largest relative miss of any such target; it is above ``TOLERANCE`` only where
the three dimensions contradict each other, and the best fit found is used.

Topics are clusters of the documents' vocabularies: a 64-dimensional signed
projection of a text's different words, centred on the mean of its language (so
that topics are not languages over again), clustered by spherical k-means.  All
rows take part in every mean and every step; sums are of integers, so the
topics do not depend on the partitioning.  A caller's ``topic`` column
replaces them.

Only the table of cells, the means of languages and the topics' centres reach
the driver, behind a count of rows (``max_cells``); beyond that the fit raises
and asks for coarser dimensions.

Defined results: null source, language or topic is the value ``(none)``; a
null or wordless text has 0 tokens, topic ``(none)`` and, in a cell without
tokens, the probability ``fraction``; rows with null or repeated ids are drawn
by id and text; repeated rows are taken or left together; very long texts are
read whole, in slices; an empty table gives an empty result; other columns are
kept by ``mix_filter`` and ignored by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import materialize, prefix
from .substring import word_hashes

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
#: Relative miss of a target at which raking ends.
TOLERANCE = 1e-6

#: Dimensions of a text's projection, the length of one, and bytes of a text handled at a time.
_DIM, _UNIT, _SLICE = 64, 1000, 1 << 20
#: Rows handled at a time.
_ROWS = 500
_SIGNS = 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) - 1


def _slices(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about ``_SLICE`` bytes, cut between words."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and text[end] != 0x20 and not 0x09 <= text[end] <= 0x0D:
            end += 1
        yield text[at:end]
        at = end


def projection(text: bytes | None) -> tuple[int, np.ndarray]:
    """Words of a text, and the direction of the sum of its different words' signs (integers)."""
    tokens, total = 0, np.zeros(_DIM, np.int64)
    for part in _slices(text or b""):
        words = word_hashes(part)
        tokens += len(words)
        seen = np.unique(words).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            total[8 * k : 8 * k + 8] += np.bincount(seen[:, k], minlength=256) @ _SIGNS
    return tokens, _unit(total)


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=-1, keepdims=True))
    return np.rint(_UNIT * v / np.maximum(length, 1e-9)).astype(np.int64)


def _vectors(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i2").reshape(-1, _DIM).astype(np.int64)


@dataclass
class Topics:
    """The means of languages and the centres of topics."""

    means: dict[str, np.ndarray]
    centres: np.ndarray

    def centred(self, langs: list[str], vectors: np.ndarray) -> np.ndarray:
        zero = np.zeros(_DIM, np.int64)
        return vectors - np.array([self.means.get(lang, zero) for lang in langs]).reshape(-1, _DIM)

    def of(self, langs: list[str], vectors: np.ndarray) -> np.ndarray:
        """The topic number of each vector: the centre of the largest product, the first of equals."""
        return (self.centred(langs, vectors) @ self.centres.T).argmax(axis=1)

    def names(self, langs: list[str], vecs: list[bytes | None]) -> list[str]:
        """The topic of each row; ``(none)`` without words."""
        some = [k for k, v in enumerate(vecs) if v is not None]
        out = [NONE] * len(vecs)
        if some:
            for k, t in zip(some, self.of([langs[k] for k in some], _vectors([vecs[k] for k in some])), strict=True):
                out[k] = f"topic{t}"
        return out

    def label(self, rows: DataFrame) -> DataFrame:
        """``rows`` (lang, vec, ...) with their topic in place of ``topic`` and without ``vec``."""
        kept = [f for f in rows.schema.fields if f.name not in ("vec", "topic")]
        names = [f.name for f in kept]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                topics = self.names(b.column("lang").to_pylist(), b.column("vec").to_pylist())
                yield pa.record_batch([*(b.column(n) for n in names), pa.array(topics, pa.string())], [*names, "topic"])

        return rows.mapInArrow(run, StructType([*kept, StructField("topic", StringType())]))


def _sums(sketches: DataFrame, key_type: str, keys_of, at_most: int) -> dict:
    """For each key the number of vectors and their sum; ``keys_of(langs, vectors)`` gives the keys and what is summed."""
    arrow = {"string": pa.string(), "int": pa.int32()}[key_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = keys_of(b.column(0).to_pylist(), _vectors(b.column(1).to_pylist()))
            if not len(rows):
                continue
            names, owner = np.unique(np.array(keys), return_inverse=True)
            sums = np.zeros((len(names), _DIM + 1), np.int64)
            np.add.at(sums, owner, np.hstack([np.ones((len(rows), 1), np.int64), rows]))
            yield pa.record_batch(
                [pa.array(np.repeat(names, _DIM + 1).tolist(), arrow), pa.array(np.tile(np.arange(_DIM + 1), len(names)), pa.int32()), pa.array(sums.ravel())],
                ["key", "d", "s"],
            )

    parts = sketches.select("lang", "vec").where("vec IS NOT NULL").mapInArrow(run, f"key {key_type}, d int, s bigint")
    got = parts.groupBy("key", "d").agg(F.sum("s").alias("s")).limit(at_most * (_DIM + 1) + 1).collect()
    if len(got) > at_most * (_DIM + 1):
        raise ValueError(f"over {at_most} languages; use coarser ones")
    out: dict = {}
    for r in got:
        out.setdefault(r.key, np.zeros(_DIM + 1, np.int64))[r.d] = r.s
    return out


def fit_topics(sketches: DataFrame, topics: int, rounds: int = 4, max_languages: int = 10_000) -> Topics:
    """Clusters of all rows of ``sketches`` (lang, vec).

    They start from the fullest orthants of the first five dimensions.
    """
    by_lang = _sums(sketches, "string", lambda langs, v: (langs, v), max_languages)
    model = Topics({k: np.rint(s[1:] / s[0]).astype(np.int64) for k, s in by_lang.items()}, np.zeros((1, _DIM), np.int64))

    def orthants(langs, v):
        x = model.centred(langs, v)
        return (x[:, :5] > 0) @ (1 << np.arange(5)), x

    start = sorted(_sums(sketches, "int", orthants, 32).items(), key=lambda kv: (-kv[1][0], kv[0]))
    if not start:
        return model
    centres = _unit(np.array([s[1:] for _, s in start[:topics]]))
    for _ in range(rounds):
        now = Topics(model.means, centres)
        for k, s in _sums(sketches, "int", lambda langs, v, now=now: (now.of(langs, v), now.centred(langs, v)), topics).items():
            centres[k] = _unit(s[1:])
    return Topics(model.means, centres)


def tempered(sizes: np.ndarray, temperature: float, given: Mapping[str, float] | None, names: list[str]) -> np.ndarray:
    share = np.where(sizes > 0, np.power(np.maximum(sizes, 1e-300), temperature), 0.0)
    share = share / share.sum()
    if given:
        named = np.array([n in given for n in names])
        fixed = np.array([float(given.get(n, 0.0)) for n in names])
        rest = max(0.0, 1.0 - fixed.sum())
        others = np.where(named, 0.0, share)
        share = fixed + (rest * others / others.sum() if others.sum() > 0 else 0.0)
        share = share / share.sum()
    return share


def capped(rate: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """The factor s at which min(1, s * rate) takes ``budget`` tokens; infinite if all of them are too few."""
    order = np.argsort(-rate, kind="stable")
    r, t = rate[order], tokens[order]
    full = np.concatenate([[0.0], np.cumsum(t)])[:-1]  # tokens of cells that reach 1 before this one
    rest = np.cumsum((r * t)[::-1])[::-1]
    s = np.divide(budget - full, rest, out=np.full_like(rest, np.inf), where=rest > 0)
    fits = np.flatnonzero((s >= 0) & (s * r <= 1 + 1e-12))
    return float(s[fits[0]]) if len(fits) else np.inf


def calibrate(tokens: np.ndarray, labels: list[np.ndarray], shares: list[np.ndarray], fraction: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Probabilities of cells, and the largest relative miss of a marginal of the expected sample.

    ``tokens`` are positive; ``labels`` number each cell's value in every dimension, ``shares`` are the values' targets.
    """
    budget = fraction * tokens.sum()
    goals = []
    for lab, share in zip(labels, shares, strict=True):
        size = np.bincount(lab, tokens, minlength=len(share))
        rate = np.divide(share, size, out=np.zeros_like(share), where=size > 0)
        goals.append(np.minimum(1.0, np.nan_to_num(capped(rate, size, budget) * rate, posinf=1.0)) * size)
    cells = [[np.flatnonzero(lab == v) for v in range(len(goal))] for lab, goal in zip(labels, goals, strict=True)]
    rate, best, least = np.full(len(tokens), fraction), np.full(len(tokens), fraction), np.inf
    for _ in range(rounds):
        for own, goal in zip(cells, goals, strict=True):
            for at, want in zip(own, goal, strict=True):
                if len(at):
                    # bounded, so that contradictory targets cannot run away
                    rate[at] = np.clip(rate[at] * min(capped(rate[at], tokens[at], want), 1e9), 1e-9, 1e9)
        p = np.minimum(1.0, rate)
        miss = max(
            float(np.max(np.abs(np.bincount(lab, p * tokens, minlength=len(goal)) - goal) / np.maximum(goal, 1e-9 * budget)))
            for lab, goal in zip(labels, goals, strict=True)
        )
        if miss < least:
            best, least = p, miss
        if miss < TOLERANCE:
            break
    return best, least


def fit(cells: DataFrame, fraction: float, temperature: float, targets: Mapping[str, Mapping[str, float]] | None, max_cells: int) -> tuple[list[tuple], float]:
    """(source, lang, topic, weight, probability) of every cell, and the residual; weight: its share of the expected sample."""
    got = cells.limit(max_cells + 1).collect()
    if len(got) > max_cells:
        raise ValueError(f"over {max_cells} cells of source, language and topic; use coarser dimensions or raise max_cells")
    got.sort(key=lambda r: (r.source, r.lang, r.topic))
    full = [r for r in got if r.tokens]
    out = [(r.source, r.lang, r.topic, 0.0, float(fraction)) for r in got if not r.tokens]
    if not full:
        return out, 0.0
    tokens = np.array([float(r.tokens) for r in full])
    labels, shares = [], []
    for d in DIMENSIONS:
        names, lab = np.unique([r[d] for r in full], return_inverse=True)
        labels.append(lab)
        shares.append(tempered(np.bincount(lab, tokens), temperature, (targets or {}).get(d), names.tolist()))
    p, residual = calibrate(tokens, labels, shares, fraction)
    weight = p * tokens / max((p * tokens).sum(), 1e-300)
    return out + [(r.source, r.lang, r.topic, float(a), float(b)) for r, a, b in zip(full, weight, p, strict=True)], residual


def uniform(ident: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) out of an identifier and a text; the same in every engine that has MD5."""
    empty = F.lit("")
    digest = F.md5(F.coalesce(text.cast("string"), empty).cast("binary"))
    key = F.concat_ws("/", F.coalesce(ident.cast("string"), empty), F.lit(str(seed)), digest)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _label(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NONE))


@dataclass
class Mixture:
    """A fitted mixture: the topics (None if the caller gave them), the cells' weights and probabilities, the residual."""

    topics: Topics | None
    cells: list[tuple]
    residual: float


def fit_mixture(rows: DataFrame, given_topic: bool, topics: int, fraction: float, temperature: float, targets, max_cells: int) -> Mixture:
    """The mixture of ``rows`` (source, lang, topic, tokens, vec)."""
    model = None if given_topic else fit_topics(rows, topics)
    labelled = (rows if model is None else model.label(rows.select("source", "lang", "tokens", "vec"))).select(*DIMENSIONS, "tokens")
    return Mixture(model, *fit(labelled.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), fraction, temperature, targets, max_cells))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None, seed: int) -> DataFrame:
    """(id, source, lang, topic, u, tokens, vec) of every row."""
    chosen = F.lit(None).cast("string") if topic is None else F.coalesce(topic.cast("string"), F.lit(NONE))
    given = docs.select(
        F.col(id_col).alias("id"),
        _label(source_col).alias("source"),
        _label(lang_col).alias("lang"),
        chosen.alias("topic"),
        uniform(F.col(id_col), F.col(text_col), seed).alias("u"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    names = given.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                each = [projection(t.as_py()) for t in b.column("text")]
                tokens = pa.array([n for n, _ in each], pa.int64())
                vecs = pa.array([v.astype("<i2").tobytes() if n else None for n, v in each], pa.binary())
                yield pa.record_batch([*(b.column(n) for n in names), tokens, vecs], [*names, "tokens", "vec"])

    return given.mapInArrow(run, StructType([*given.schema.fields[:-1], StructField("tokens", LongType()), StructField("vec", BinaryType())]))


def mix(
    docs: DataFrame,
    fraction: float = 0.5,
    temperature: float = 0.7,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    seed: int = 42,
    max_cells: int = 100_000,
    topics: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, weight (of its cell), probability, selected, residual (of the fit)."""
    rows = materialize(_rows(docs, id_col, text_col, source_col, lang_col, topic, seed), "mix-rows")
    fitted = fit_mixture(rows, topic is not None, topics, fraction, temperature, targets, max_cells)
    weights = docs.sparkSession.createDataFrame(
        fitted.cells, "c_source string, c_lang string, c_topic string, weight double, probability double"
    )
    labelled = rows if fitted.topics is None else fitted.topics.label(rows)
    # the size is proven: at most max_cells rows
    joined = labelled.join(
        F.broadcast(weights), (F.col("source") == F.col("c_source")) & (F.col("lang") == F.col("c_lang")) & (F.col("topic") == F.col("c_topic"))
    )
    return joined.select(
        F.col("id").alias("doc_id"),
        *DIMENSIONS,
        "tokens",
        F.round("weight", 9).alias("weight"),
        F.round("probability", 9).alias("probability"),
        (F.col("u") < F.round("probability", 9)).alias("selected"),
        F.lit(round(fitted.residual, 9)).alias("residual"),
    )


def mix_filter(
    docs: DataFrame,
    fraction: float = 0.5,
    temperature: float = 0.7,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    seed: int = 42,
    max_cells: int = 100_000,
    topics: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` selects; columns unchanged, rows with null or repeated ids one by one.

    Texts are projected a second time rather than written a second time.
    """
    p = prefix(docs)
    rows = materialize(_rows(docs, id_col, text_col, source_col, lang_col, topic, seed).drop("id", "u"), "mix-cells")
    fitted = fit_mixture(rows, topic is not None, topics, fraction, temperature, targets, max_cells)
    weights = docs.sparkSession.createDataFrame(
        fitted.cells, f"{p}s string, {p}l string, {p}t string, {p}w double, {p}p double"
    )
    own = docs.withColumns({p + "1": _label(source_col), p + "2": _label(lang_col)})
    if topic is not None:
        own = own.withColumn(p + "3", F.coalesce(topic.cast("string"), F.lit(NONE)))
    else:
        own = _with_topic(own, fitted.topics, text_col, p + "2", p + "3")
    joined = own.join(F.broadcast(weights), F.expr(f"{p}1 = {p}s AND {p}2 = {p}l AND {p}3 = {p}t"))
    taken = joined.where(uniform(F.col(id_col), F.col(text_col), seed) < F.round(p + "p", 9))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


def _with_topic(docs: DataFrame, model: Topics, text_col: str, lang_col: str, name: str) -> DataFrame:
    """``docs`` with the topic of each text; all columns pass through."""
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                vecs = []
                for t in b.column(text):
                    t = t.as_py()
                    n, v = projection(t.encode() if isinstance(t, str) else t)
                    vecs.append(v.astype("<i2").tobytes() if n else None)
                topics = model.names(b.column(lang).to_pylist(), vecs)
                yield pa.record_batch([*b.columns, pa.array(topics, pa.string())], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))
