"""Language ID with very many languages and with rows that cannot be learned from."""

import random

import numpy as np

from tracelode.llm import language


def test_two_hundred_languages(spark):
    """Each with an alphabet of its own; long texts, repeated and null ids."""
    draw = random.Random(5)
    tongues = {f"x{k:03}": [chr(0x4E00 + 40 * k + j) for j in range(30)] for k in range(200)}
    word = lambda tongue: "".join(draw.choice(tongues[tongue]) for _ in range(draw.randrange(2, 7)))
    docs = [(None if k % 3 else k, " ".join(word(t) for _ in range(40)), t) for k in range(30) for t in tongues]
    docs += [(1, None, "x000"), (2, "", "x001"), (3, "12 34", "x002"), (4, " ".join(word("x003") for _ in range(200_000)), "x003")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = language.learn(table, max_rows=1000)
    assert len(model.families.classes) == 200 and not model.families.paired
    counts = np.array([language.features(t) for _, t, _ in docs[:400]])
    right = [lang == want for (lang, _), (_, _, want) in zip(model.predict(counts), docs[:400], strict=True)]
    assert np.mean(right) > 0.95
    got = language.predict(table, model).collect()
    assert len(got) == len(docs) and sum(r.lang_pred == "und" for r in got) == 3


def test_sample_is_bounded(spark):
    docs = [(k, f"wort und satz {k}" if k % 2 else f"word and sentence {k}", "de" if k % 2 else "en") for k in range(2000)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    x, langs = language.training_sample(table, "doc_id", "text", "lang", language.F.lit(True), 50, 60)
    assert x.shape == (60, language.DIM) and langs.count("de") == langs.count("en") == 30
    x, langs = language.training_sample(table.where("doc_id < 20"), "doc_id", "text", "lang", language.F.lit(True), 50, 4000)
    assert len(langs) == 20
