"""The pipeline's filters on rows with null and repeated ids and different texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import decontam, language, simhash

PASSAGE = " ".join(f"passage{k}" for k in range(30))
FIRST = " ".join(f"apple{k} grows" for k in range(40))
SECOND = " ".join(f"river{k} flows" for k in range(40))
THIRD = " ".join(f"stone{k} rests" for k in range(40))
SCHEMA = "doc_id bigint, text string, lang string"


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("i", [None, 7])
def test_near_dedup_keeps_a_row_of_each_component(spark, i):
    rows = [(i, FIRST), (i, SECOND), (i, THIRD), (i, THIRD), (9, SECOND)]
    # SECOND: the least id stays, and a null id comes last
    want = [(i, FIRST), (9 if i is None else i, SECOND), (i, THIRD)]
    assert texts(simhash.near_dedup_filter(table(spark, rows))) == sorted(want, key=str)


@pytest.mark.parametrize("i", [None, 7])
def test_language_filter_judges_each_row(spark, i):
    rows = [(i, "12 34 !"), (i, None), (i, FIRST), (i, SECOND), (i, SECOND), (1, THIRD), (2, "...")]
    assert texts(language.language_filter(table(spark, rows))) == sorted([(i, FIRST), (i, SECOND), (i, SECOND), (1, THIRD)], key=str)


@pytest.mark.parametrize("i", [None, 7])
def test_decontaminate_judges_each_row(spark, i):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    rows = [(i, "x " + PASSAGE), (i, FIRST), (i, SECOND), (i, SECOND), (i, None), (1, PASSAGE)]
    want = [(i, FIRST), (i, SECOND), (i, SECOND), (i, None)]
    assert texts(decontam.decontaminate(table(spark, rows), bench)) == sorted(want, key=str)


def test_decontaminate_drops_rows_with_any_full_window(spark):
    """A passage of a long text is far below the share of a contaminated one; a short item within it does not count."""
    passage = " ".join(f"w{k}" for k in range(40))
    bench = spark.createDataFrame([(1, passage), (2, "only four words here")], "item_id bigint, text string")
    long = " ".join(f"own{k}" for k in range(3000))
    rows = [
        (1, f"{long} W7, w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 {long}"), (2, f"{long} w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 {long}"),
        (3, f"{long} only four words here"), (4, "Only four words here!"), (5, long),
    ]
    assert [i for i, _ in texts(decontam.decontaminate(table(spark, rows), bench))] == [2, 3, 5]


def test_crowded_buckets_are_split(monkeypatch):
    """Links of a bucket over the bound connect what all links connect."""
    rng = np.random.default_rng(3)
    agreed = (1 << 64) - 1 ^ ((1 << 30) - 1)
    centres = rng.integers(0, 1 << 30, 150)
    fps = np.unique(np.concatenate([centres ^ (1 << rng.integers(0, 30, 150)) ^ (1 << rng.integers(0, 30, 150)) for _ in range(4)])).astype(np.int64)

    def classes(links):
        up = {int(f): int(f) for f in fps}

        def top(f):
            while up[f] != f:
                f = up[f]
            return f

        for a, b in zip(*links, strict=True):
            up[max(top(a), top(b))] = min(top(a), top(b))
        return {f: top(f) for f in up}

    every = [(int(a), int(b)) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 3]
    want = classes(zip(*every, strict=True))
    assert classes(simhash.forest(fps, 3)) == want
    monkeypatch.setattr(simhash, "CROWD", 16)
    assert classes(simhash.forest(fps, 3, agreed)) == want and len(set(want.values())) < len(fps)


def test_mixing_draws_rows_without_id_one_by_one(spark):
    from tracelode.llm import mixing

    rows = [(None, f"text {k} of many rows without id") for k in range(400)] + [(1, f"again {k}") for k in range(400)]
    got = mixing.mix_filter(table(spark, rows).withColumn("source", F.lit("web")))
    counts = dict(got.groupBy("doc_id").count().collect())
    assert 120 < counts[None] < 280 and 120 < counts[1] < 280


@pytest.mark.parametrize("bits", [(63,), (63, 0), (63, 62, 61), (0, 31, 32), (63, 40, 2)])
def test_links_over_any_bits(spark, bits):
    """The sign bit counts like any other; a fourth bit is one too many."""
    fps = [0, -1, 0x123456789ABCDEF, -0x123456789ABCDEF]
    signed = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
    near = [signed((f % (1 << 64)) ^ sum(1 << b for b in bits)) for f in fps]
    far = [signed((f % (1 << 64)) ^ sum(1 << b for b in (63, 50, 20, 10))) for f in fps]
    table = spark.createDataFrame([(f,) for f in dict.fromkeys(fps + near + far)], "fp bigint")
    got = {frozenset(r) for r in simhash.links(table).collect()}
    every = [r.fp for r in table.collect()]
    want = {frozenset((a, b)) for a in every for b in every if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert got <= want and {frozenset(p) for p in zip(fps, near, strict=True)} <= want

    def classes(pairs):
        up = {f: {f} for f in every}
        for p in pairs:
            whole = set().union(*(up[f] for f in p))
            for f in whole:
                up[f] = whole
        return up

    assert classes(got) == classes(want)
