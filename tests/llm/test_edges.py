"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelode.llm import chat, decontam, exact_dedup, html_text, language, lines, mixing, pii, simhash, substring

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp string, u int, kept string, lines string, digest string, __tl_id int"
LONG = " ".join(f"word{k % 997} and then" for k in range(60_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
TEXTS = [
    (1, "The same text, said twice over here."), (2, "The same text, said twice over here."), (2, "The same text, said twice over here."),
    (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, LONG + " end"), (8, "a"), (None, "no identifier at all"), (None, None),
    (9, "before " + PASSAGE), (10, PASSAGE + " after"), (11, "\u00e9t\u00e9 \U0001f600 mail a@b.co or 10.0.0.1"), (12, "line one is long enough to count here\nline two"),
    (13, "line one is long enough to count here\nline two"),
]
DOCS = {
    "lang": language.identify, "substring": substring.substring_dedup, "pii": pii.find_spans, "exact": exact_dedup.exact_groups,
    "lines": lines.line_dedup, "simhash": simhash.near_groups, "mix": mixing.mix,
}


@pytest.fixture(scope="module")
def odd(spark):
    data = [(i, t, None if k % 3 else "en", None if k % 2 else "web", None, "x", "y", k, "z", "l", "d", k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    return spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "lone item"), (4, PASSAGE)], "item_id bigint, text string")


@pytest.mark.parametrize("name", DOCS)
def test_odd_rows_and_empty_tables(odd, name):
    got = DOCS[name](odd).collect()
    assert len(got) == len(TEXTS)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in TEXTS)
    assert DOCS[name](odd.limit(0)).collect() == []


def test_results_of_odd_rows(odd):
    by = lambda df: {r.doc_id: r for r in df.collect()}
    lang = by(language.identify(odd))
    assert {i: lang[i].lang_pred for i in (3, 4, 5)} == dict.fromkeys((3, 4, 5), "und") and lang[1].lang_pred == "en"
    cut = by(substring.substring_dedup(odd))
    assert (cut[10].n_removed, cut[10].kept, cut[9].n_removed) == (60, "after", 0)
    assert (cut[7].n_removed, cut[7].kept) == (180_000, "end") and cut[6].n_removed == 0 and cut[3].n_words == 0
    spans = by(pii.find_spans(odd))
    assert [(s.start, s.end) for s in spans[11].email] == [(11, 17)] and [(s.start, s.end) for s in spans[11].ip] == [(21, 29)]
    same = by(exact_dedup.exact_groups(odd))
    assert (same[1].keep_id, same[1].group_size, same[2].kept) == (1, 3, False)
    assert (same[3].keep_id, same[3].group_size, same[4].kept) == (5, 4, False)
    cut = by(lines.line_dedup(odd))
    assert (cut[12].n_removed, cut[13].n_removed, cut[13].kept) == (0, 2, "")
    near = by(simhash.near_groups(odd))
    assert near[2].component_id == 1 and near[3].fingerprint == "0" * 16 and near[5].component_id == 3 and near[7].component_id == 6


def test_filters_keep_columns(spark, odd, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, str(tmp_path))
            assert got.columns == odd.columns, name
            n = got.count()
            assert n <= table.count(), name
    assert {r.doc_id for r in exact_dedup.exact_dedup_filter(odd).collect()} == {1, 5, 6, 7, 8, 9, 10, 11, 12, None}
    assert exact_dedup.exact_dedup_filter(odd).where("doc_id = 1").count() == 1


@pytest.mark.parametrize("bound", [16 << 20, 200])
def test_decontamination(odd, bench, bound):
    """A benchmark above the block bound is scanned in blocks, with the same result."""
    got = {r.doc_id: r for r in decontam.find_leaks(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), bench, max_block_bytes=bound).collect()}
    assert (got[9].n_words, got[9].n_hit, got[9].items, got[9].contaminated) == (61, 60, ["4"], True)
    assert [(s.start, s.end) for s in got[9].spans] == [(7, 7 + len(PASSAGE))]
    assert (got[3].n_words, got[3].n_hit, got[3].contaminated) == (0, 0, False)
    assert decontam.find_leaks(odd.limit(0), bench).collect() == []
    assert not decontam.find_leaks(odd, bench.limit(0)).where("contaminated").count()
    assert decontam.find_leaks(odd, bench).count() == len(TEXTS)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class="cookie">We use cookies</div>
<article><h1>Head &amp; shoulders</h1><p>First   paragraph
goes on.</p><aside>Advert</aside><p>caf&eacute; &#x41;<script>var a="<p>no</p>";</script></p></article><div class="comments"><p>Nice post!</p></div><footer>End</footer></body></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<p>unclosed <b>text")], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[1] == "Head & shoulders\nFirst paragraph goes on.\ncaf\u00e9 A"
    assert got[2] == "" and got[None] == ""
    assert html_text.extract(pages.limit(0)).collect() == []


def test_chat(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\<s>[x]\n</s>\\"), (1, 2, "user", None), (1, 3, "assistant", "bye"), (2, 0, None, "q"), (None, None, "user", "?"), (1, 3, "assistant", "bye")]
    talks = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("target", F.lit("clash"))
    got = chat.prefix_target_examples(talks).collect()
    mine = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.target)
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in mine] == ["\\<s>[x]\n</s>\\", "bye", "bye"]
    assert list(chat.read_turns(mine[0].text)) == [("user", "hi"), ("assistant", "\\<s>[x]\n</s>\\")]
    assert len(got) == 5 and len(chat.read_back(chat.prefix_target_examples(talks)).collect()) == 3
    assert chat.read_back(chat.prefix_target_examples(talks.limit(0))).collect() == []
