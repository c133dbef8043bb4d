"""Rows that share an id, or have none, with different texts: each is judged by its own text."""

import pytest
from pyspark.sql import functions as F

from tracelode.llm import exact_dedup, lines, pii, substring

PASSAGE = " ".join(f"passage{k}" for k in range(60))
OWN = " ".join(f"own{k}" for k in range(70))
SCHEMA = "doc_id bigint, text string"





@pytest.mark.parametrize("crowd", [2000, 1])
def test_substring(spark, crowd):
    docs = [(1, "start " + PASSAGE), (2, OWN), (2, PASSAGE + " end"), (2, "a b c d e"), (2, PASSAGE + " end"), (3, OWN + " x"), (None, PASSAGE), (None, None), (2, None)]
    got = substring.substring_dedup(spark.createDataFrame(docs, SCHEMA), crowd=crowd)
    rows = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=repr)
    want = [
        (1, 61, 0, docs[0][1]), (2, 70, 0, OWN), (2, 61, 60, "end"), (2, 61, 60, "end"), (2, 5, 0, "a b c d e"), (3, 71, 70, "x"),
        (None, 60, 0, PASSAGE), (None, 0, 0, ""), (2, 0, 0, ""),
    ]
    assert rows == sorted(want, key=repr)


@pytest.mark.parametrize("crowd", [2000, 3])
def test_substring_of_few_different_words(spark, crowd):
    """Texts of one minimiser, and buckets over the bound, against all windows."""
    texts = {1: "a " * 400, 2: "b " * 30 + "a " * 300 + "b", 3: ("a b " * 100).strip(), 4: "b " + "a b " * 99, 5: "a " * 49, 6: "c " * 60, 7: "c " * 49 + "d", 8: "c " * 51}
    texts |= {k: PASSAGE + f" tail{k} " + " ".join(f"w{k % 3}x{j}" for j in range(60)) for k in range(10, 20)}
    words = {i: t.split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    got = {r.doc_id: r for r in substring.substring_dedup(spark.createDataFrame(list(texts.items()), SCHEMA), crowd=crowd).collect()}
    for i, w in words.items():
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))


def test_runs_are_bounded():
    m, first, size = substring.runs(b"a " * 5000, 50, 8)
    assert size.max() <= 64 and size.sum() == 4951 and (first[1:] == (first + size)[:-1]).all() and len(set(m.tolist())) == 1


def test_lines(spark):
    docs = [
        (1, "one\ntwo\nthree"), (2, "zero"), (2, "a\nb\none\ntwo"), (2, "one\ntwo\nc"), (2, "a\nb\none\ntwo"), (3, "a\nb"), (None, "one\ntwo"), (2, None),
    ]
    got = lines.line_dedup(spark.createDataFrame(docs, SCHEMA))
    rows = sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in got.collect()), key=repr)
    want = [
        (1, 3, 0, docs[0][1]), (2, 1, 0, "zero"), (2, 4, 2, "a\nb"), (2, 4, 2, "a\nb"), (2, 3, 2, "c"), (3, 2, 2, ""), (None, 2, 0, "one\ntwo"), (2, 0, 0, ""),
    ]
    assert rows == sorted(want, key=repr)


def test_exact_dedup_regroups_texts_of_one_digest(spark):
    """With a digest of one hex digit, texts of different bytes meet and are told apart."""
    docs = [(k, f"text {k % 40}" + " " * (k % 3)) for k in range(120)] + [(500, "text 1"), (500, "text 1")]
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    got = exact_dedup.exact_groups(spark.createDataFrame(docs, SCHEMA), digest=weak).collect()
    members = {}
    for i, t in docs:
        members.setdefault(t.strip(), []).append((-len(t), i))
    text = {i: t.strip() for i, t in docs}
    for r in got:
        own = members[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(own)[1], len(own), r.doc_id == min(own)[1])
    assert len(got) == len(docs)


def test_exact_filter_keeps_the_longest_of_an_id(spark):
    docs = [(1, "a b"), (1, "a  b "), (1, "ab"), (2, "a b"), (None, "c"), (None, " c"), (None, None), (3, "")]
    got = exact_dedup.exact_dedup_filter(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "a  b "), (None, " c"), (3, "")], key=repr)


def test_spans_of_each_row(spark):
    docs = [(1, "a@b.co"), (1, "none"), (None, "x a@b.co"), (None, None)]
    got = pii.find_spans(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((str(r.doc_id), [s.start for s in r.email]) for r in got) == [("1", []), ("1", [0]), ("None", []), ("None", [2])]
