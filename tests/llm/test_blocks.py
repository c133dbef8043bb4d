"""A benchmark above the block bound gives the same rows as one below it, null and repeated ids included."""

import random

import pytest

from tracelode.llm import decontam

ONE = " ".join(f"first{k}" for k in range(20))
TWO = " ".join(f"second{k}" for k in range(20))
DOCS = [
    (None, "a " + ONE), (None, TWO + " b c"), (None, None), (None, "clean"), (1, ONE), (1, ONE), (2, ONE + " and " + TWO),
    (2, "clean words only"), (2, "x " + TWO), (3, ""),
]


def test_blocks_keep_rows_apart(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = [(1, ONE), (2, TWO), *[(k, f"item {k} of many others that fill up blocks") for k in range(3, 12)]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(str, decontam.find_leaks(docs, bench).collect()))
    blocks = sorted(map(str, decontam.find_leaks(docs, bench, max_block_bytes=300).collect()))
    assert len(whole) == len(DOCS) and blocks == whole


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_automaton_finds_all_windows(window):
    """Against every window of every item, with few different words so that seeds and windows repeat."""
    draw = random.Random(window)
    word = lambda n: b" ".join(draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randrange(n)))
    for _ in range(60):
        items = [(str(k % 7), word(4 * window)) for k in range(9)]
        owners, sizes = {}, set()
        for item, text in items:
            w = text.split()
            size = min(window, len(w))
            for k in range(len(w) - size + 1 if size else 0):
                owners.setdefault(tuple(w[k : k + size]), set()).add(item)
                sizes.add(size)
        machine = decontam.Automaton(items, window)
        for _ in range(5):
            w, hit, who, full = word(9 * window + 20).split() + [b"other"] * 3, set(), set(), False
            draw.shuffle(w)
            for size in sizes:
                for k in range(len(w) - size + 1):
                    if found := owners.get(tuple(w[k : k + size])):
                        hit |= set(range(k, k + size))
                        who |= found
                        full |= size == window
            spans, got, any_full = machine.find(w)
            assert ({k for s, e in spans for k in range(s, e)}, got, any_full) == (hit, who, full)
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
