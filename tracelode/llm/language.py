"""Hierarchical language identification.

First the language family is predicted, then one-versus-one linear support
vector machines separate the languages within it.  Families are told apart
one-versus-one, too, or one against the rest if there are over ``MANY``.  Both
levels are linear machines over square-rooted frequencies of hashed letter
n-grams (1 to 3) of the whole text; only the text is ever an input of a
prediction.

Training rows are a documented sample: at most ``per_language`` labelled rows
of each language and at most ``max_rows`` in all (every language gets the same
part of them, one row at least), those of the least hash of identifier and
text.  Executors compute their features; the driver gets these alone, at most
32 KB a row, so it holds a bounded set whatever the corpus size and the length
of texts.  More languages than ``max_rows`` raise an error.

Defined results: a null text, or one without a letter, is ``und`` with score
0, as is every text if no labelled row exists; rows whose label is null are
not learned from; a text of one letter is predicted like any other; a very
long text is read whole, in slices; a row with a null or repeated id is
predicted by its own text, and repeated rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, prefix, text_key

UND = "und"

# Families of common languages (ISO 639-1). Others are a family each.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr uz",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

#: Hashed features, and code points of a text handled at a time.
DIM, _SLICE = 1 << 13, 1 << 20
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_SHIFT = np.uint32(32 - 13)
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters, and one entry for all beyond the basic plane."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x10000)] + [True])
    return _LETTER


def features(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter n-grams; None if there is no letter."""
    counts, any_letter = np.zeros(DIM, np.int64), False
    text = text or ""
    for at in range(0, len(text), _SLICE):
        points = np.frombuffer(text[at : at + _SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[np.minimum(points, 0x10000)]
        if not letter.any():
            continue
        any_letter = True
        points = np.where(letter, points, np.uint32(32))
        points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]])
        points = points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]
        one = points * _MIX[0]
        two = one[:-1] * _MIX[1] + one[1:]
        three = two[:-1] * _MIX[1] + one[2:]
        h = np.concatenate([one, two, three])
        h ^= h >> np.uint32(15)
        h *= _MIX[2]
        h >>= _SHIFT
        counts += np.bincount(h, minlength=DIM)
    return counts if any_letter else None


def _scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights of an L2-regularised linear SVM (hinge loss, dual coordinate descent); y is +1 or -1."""
    rng = np.random.default_rng(7)
    w, alpha = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    norms = np.maximum((x.astype(np.float64) ** 2).sum(axis=1), 1e-12)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norms[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


#: Classes beyond which each is told from the rest instead of from every other.
MANY = 12


def _rest_sample(own: np.ndarray) -> np.ndarray:
    """The rows of a class and, for each of them, four others (200 at least)."""
    others = np.flatnonzero(~own)
    at_most = max(200, 4 * int(own.sum()))
    if len(others) > at_most:
        others = np.sort(np.random.default_rng(11).choice(others, at_most, replace=False))
    return np.concatenate([np.flatnonzero(own), others])


@dataclass
class Machines:
    """Linear machines over a list of classes: one for each pair, or one for each class."""

    classes: list[str]
    paired: bool
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, paired: bool) -> Machines:
        classes = sorted(set(labels.tolist()))
        rows = []
        for a, b in combinations(classes, 2) if paired else [(c, None) for c in classes]:
            own = labels == a
            pick = np.flatnonzero(own | (labels == b)) if paired else _rest_sample(own)
            rows.append(linear_svm(x[pick], np.where(own[pick], 1.0, -1.0)))
        return cls(classes, paired, np.array(rows, np.float32).reshape(-1, x.shape[1]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and scores in 0..1: the mean squashed margin of the winner's duels, or that against the rest."""
        k = len(self.classes)
        won = np.zeros((len(x), k), np.float32)
        p = 1 / (1 + np.exp(-3 * (x @ self.weights.T)))
        if self.paired:
            for n, (a, b) in enumerate(combinations(range(k), 2)):
                won[:, a] += p[:, n]
                won[:, b] += 1 - p[:, n]
            won /= max(k - 1, 1)
        else:
            won = p
        best = won.argmax(axis=1)
        return best, won[np.arange(len(x)), best] if k > 1 else np.ones(len(x), np.float32)


@dataclass
class Model:
    families: Machines
    within: dict[str, Machines]

    def predict(self, counts: np.ndarray) -> list[tuple[str, float]]:
        x = _scaled(counts)
        fam, score = self.families.predict(x)
        out: list[tuple[str, float]] = [(UND, 0.0)] * len(x)
        for f, name in enumerate(self.families.classes):
            rows = np.flatnonzero(fam == f)
            if len(rows):
                lang, inner = self.within[name].predict(x[rows])
                for r, lg, s in zip(rows, lang, inner, strict=True):
                    out[r] = (self.within[name].classes[lg], float(min(1.0, score[r] * s)))
        return out


def train(x: np.ndarray, langs: list[str]) -> Model | None:
    """The machines of scaled features and their languages."""
    if not len(x):
        return None
    y = np.array(langs)
    family = np.array([FAMILY_OF.get(lang, "-" + lang) for lang in langs])
    names = sorted(set(langs))
    paired = len({FAMILY_OF.get(lang, "-" + lang) for lang in names}) <= MANY
    return Model(
        Machines.fit(x, family, paired), {f: Machines.fit(x[family == f], y[family == f], True) for f in sorted(set(family.tolist()))}
    )


def training_sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn_from: Column, per_language: int, max_rows: int
) -> tuple[np.ndarray, list[str]]:
    """Scaled features and languages of the bounded sample.

    A first pass counts labels only, which sets each language's hash threshold
    near the bound; the exact bound is then cut from what passes it.
    """
    labelled = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("i"))
    sizes = labelled.groupBy("lang").count().limit(max_rows + 1).collect()
    if len(sizes) > max_rows:
        raise ValueError(f"over {max_rows} languages to learn; use fewer or raise max_rows")
    if not sizes:
        return np.empty((0, DIM), np.float32), []
    quota = max(1, min(per_language, max_rows // len(sizes)))
    share = docs.sparkSession.createDataFrame([(r[0], min(1.0, 1.5 * quota / r[1] + 8 / r[1])) for r in sizes], "l string, share double")
    near = labelled.withColumn("h", F.xxhash64("i", "text", F.lit("language sample")))
    # the size is proven: at most max_rows languages
    near = near.join(F.broadcast(share), F.col("lang") == F.col("l")).where(F.col("h").cast("double") / F.lit(2.0**64) + F.lit(0.5) <= F.col("share"))
    first = W.partitionBy("lang").orderBy("h", "i", "text")
    chosen = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= quota).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, where, what = [], [], []
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                counts = features(text.as_py())
                if counts is not None:
                    some = np.flatnonzero(counts)
                    langs.append(lang.as_py())
                    where.append(some.astype(np.uint16).tobytes())
                    what.append(_scaled(counts)[some].astype(np.float16).tobytes())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(where, pa.binary()), pa.array(what, pa.binary())], ["lang", "at", "x"])

    got = sorted(tuple(r) for r in chosen.mapInArrow(run, "lang string, at binary, x binary").collect())
    x = np.zeros((len(got), DIM), np.float32)
    for row, (_, where, what) in zip(x, got, strict=True):
        row[np.frombuffer(where, np.uint16)] = np.frombuffer(what, np.float16)
    return x, [lang for lang, _, _ in got]


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    learn_from: Column | None = None,
    per_language: int = 500,
    max_rows: int = 4000,
) -> Model | None:
    """The model of a sample of the labelled rows; ``learn_from``: rows that may be learned from."""
    rows = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    return train(*training_sample(docs, id_col, text_col, lang_col, rows, per_language, max_rows))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    learn_from: Column | None = None,
    per_language: int = 500,
    max_rows: int = 4000,
) -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    ``learn_from`` says which rows may be learned from (default: all with a label).
    """
    return predict(docs, learn(docs, id_col, text_col, lang_col, learn_from, per_language, max_rows), id_col, text_col)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``identify`` with a given model."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                counts = [features(t.as_py()) for t in b.column(1)]
                langs, scores = [UND] * b.num_rows, [0.0] * b.num_rows
                some = [k for k, c in enumerate(counts) if c is not None]
                if some and model:
                    for k, (lang, score) in zip(some, model.predict(np.array([counts[k] for k in some])), strict=True):
                        langs[k], scores[k] = lang, score
                yield pa.record_batch(
                    [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_filter(docs: DataFrame, id_col: str = "doc_id", min_score: float = 0.25, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without rows of no recognisable language (``und``, or a score under ``min_score``); columns unchanged.

    With duels at both levels no winner's score is under 0.25, so the default
    rejects ``und`` only: letter junk and texts in languages never learned stay.
    Null and letterless texts go; an empty table gives an empty result.
    Each row is judged by its own text, whatever its id: rows with null or
    repeated ids stay or go one by one, and repeated rows share their fate.
    """
    p = prefix(docs)
    keyed = docs.select(text_key(docs[text_col]).alias(p + "key"), docs[text_col].alias(p + "text"))
    out = predict(keyed, learn(docs, id_col, text_col, **how), p + "key", p + "text")
    out = out.where((F.col("lang_pred") == UND) | (F.col("score") < min_score))
    out = materialize(out.select(F.col("doc_id").alias(p + "key")).distinct(), "language-rejects")
    return docs.join(out, text_key(docs[text_col]) == out[p + "key"], "left_anti")
