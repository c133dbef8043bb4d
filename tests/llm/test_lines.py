"""Line dedup against all pairs by brute force, with blocks in many documents."""

import random

import pytest

from tracelode.llm import lines


def brute(docs, min_lines, min_words):
    """What each document loses to any earlier one: shared runs of min_lines lines and shared long lines."""
    full = {i: [x.strip() for x in t.split("\n") if x.strip()] for i, t in docs.items()}
    out = {}
    for j, b in full.items():
        gone = set()
        for i, a in full.items():
            if i < j:
                runs = {tuple(a[k : k + min_lines]) for k in range(len(a) - min_lines + 1)}
                for k in range(len(b)):
                    if tuple(b[k : k + min_lines]) in runs:
                        gone |= set(range(k, k + min_lines))
                    if len(b[k].split()) >= min_words and b[k] in a:
                        gone.add(k)
        out[j] = (len(b), len(gone), [x for k, x in enumerate(b) if k not in gone])
    return out


def found(spark, docs, **how):
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    return {r.doc_id: (r.n_lines, r.n_removed, [x.strip() for x in r.kept.split("\n") if x.strip()]) for r in lines.line_dedup(table, **how).collect()}


def test_a_block_in_more_than_eight_documents_goes(spark):
    docs = {1: "Short one", 2: "Short two"} | {i: "Short one\nShort two" for i in range(10, 22)}
    got = found(spark, docs)
    assert {i: r[1] for i, r in got.items()} == {1: 0, 2: 0, 10: 0} | dict.fromkeys(range(11, 22), 2)


@pytest.mark.parametrize("min_lines", [2, 3])
def test_all_pairs(spark, min_lines):
    draw = random.Random(3)
    pool = [f"short {k}" for k in range(12)] + [f"line {k} has quite enough words to go alone" for k in range(4)]
    docs = {i: "\n".join(draw.choice([*pool, f"own {i} {draw.random()}", "", " "]) for _ in range(draw.randrange(14))) for i in range(120)}
    assert found(spark, docs, min_lines=min_lines) == brute(docs, min_lines, 8)


def test_registered_query_on_the_whole_table(spark):
    """Texts of the small table, kept lines and blank ones included."""
    import hashlib

    import pandas as pd

    from tracelode.llm.queries import QUERIES

    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    docs = {int(i): t if isinstance(t, str) else "" for i, t in zip(d.doc_id, d.text, strict=True)}
    want = brute(docs, 2, 8)
    got = {r.doc_id: r for r in QUERIES["op9_line_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        n, n_gone, kept = want[i]
        assert (got[i].n_lines, got[i].n_removed, got[i].n_partners > 0) == (n, n_gone, n_gone > 0)
        if not n_gone:
            assert got[i].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(r.n_removed for r in got.values()) > 0
