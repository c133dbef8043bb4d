"""Each registered corpus query against a brute-force version over whole tables."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

import __spark_entry__
import corpus_pipeline
from tracelode.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def docs(small):
    d = pd.read_parquet(f"{small}/documents.parquet")
    return {int(i): t if isinstance(t, str) else None for i, t in zip(d.doc_id, d.text, strict=True)}


def rows(spark, small, name, key="doc_id"):
    got = QUERIES[name](spark, small).collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert "pipeline" in names


def word_hash(word):
    """The hash that projections are made of, in plain integers."""
    full, r = (1 << 64) - 1, 0x9E3779B97F4A7C15
    h = sum((b + 1) * pow(r, k, 1 << 64) for k, b in enumerate(word)) & full
    h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & full
    return h ^ h >> 29


def unit(v):
    return [round(1000 * x / max(sum(y * y for y in v) ** 0.5, 1e-9)) for x in v]


def projected(text):
    words = set(text.encode().split())
    bits = [word_hash(w).to_bytes(8, "little") for w in words]
    return unit([sum(1 if b[k // 8] >> (7 - k % 8) & 1 else -1 for b in bits) for k in range(64)])


def topics_of(texts, langs, n=8):
    """Spherical k-means over all documents, in plain integers."""
    vec = {i: projected(t) for i, t in texts.items() if t and t.split()}
    mean = {}
    for lang in set(langs.values()):
        own = [vec[i] for i in vec if langs[i] == lang]
        mean[lang] = [round(sum(c) / len(own)) for c in zip(*own, strict=True)] if own else [0] * 64
    x = {i: [a - b for a, b in zip(v, mean[langs[i]], strict=True)] for i, v in vec.items()}
    orthants = {}
    for i, v in x.items():
        orthants.setdefault(sum((v[k] > 0) << k for k in range(5)), []).append(i)
    first = sorted(orthants.items(), key=lambda kv: (-len(kv[1]), kv[0]))[:n]
    centres = [unit([sum(c) for c in zip(*(x[i] for i in ids), strict=True)]) for _, ids in first]
    nearest = lambda v: max(range(len(centres)), key=lambda k: (sum(a * b for a, b in zip(v, centres[k], strict=True)), -k))
    for _ in range(4):
        at = {i: nearest(v) for i, v in x.items()}
        for k in set(at.values()):
            centres[k] = unit([sum(c) for c in zip(*(x[i] for i in x if at[i] == k), strict=True)])
    return {i: f"topic{nearest(x[i])}" if i in x else "(none)" for i in texts}


def bisected(f, want):
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < want else (lo, mid)
    return hi


def goals_of(sizes, fraction, temperature=0.7):
    """Tokens that each value should have in the sample; values that are too small are taken whole."""
    budget = fraction * sum(sizes.values())
    share = {v: n**temperature for v, n in sizes.items()}
    m = bisected(lambda m: sum(min(n, m * share[v]) for v, n in sizes.items()), budget)
    return {v: min(n, m * share[v]) for v, n in sizes.items()}


def test_mixing(spark, small, docs):
    got = pd.DataFrame([r.asDict() for r in rows(spark, small, "op1_source_mixing").values()])
    assert set(got.doc_id) == set(docs)
    assert got.tokens.tolist() == [len(WORD.findall(docs[i] or "")) for i in got.doc_id]
    langs = dict(zip(got.doc_id, got.lang, strict=True))
    assert dict(zip(got.doc_id, got.topic, strict=True)) == topics_of(docs, langs) and got.topic.nunique() > 4
    cells = got.groupby(["source", "lang", "topic"], as_index=False).agg(tokens=("tokens", "sum"), p=("probability", "first"), n=("probability", "nunique"), w=("weight", "first"))
    assert (cells.n == 1).all() and cells.p.between(0, 1).all()
    have = cells.p * cells.tokens
    assert np.allclose(cells.w, have / have.sum(), atol=1e-6)
    miss = 0.0
    for d in ("source", "lang", "topic"):
        sizes = cells.groupby(d).tokens.sum()
        for v, want in goals_of(sizes[sizes > 0].to_dict(), 0.5).items():
            miss = max(miss, abs(have[cells[d] == v].sum() - want) / want)
    assert miss == pytest.approx(got.residual[0], abs=1e-4) and got.residual.nunique() == 1
    for i, p, s in zip(got.doc_id, got.probability, got.selected, strict=True):
        key = f"{i}/42/{hashlib.md5((docs[i] or '').encode()).hexdigest()}"
        assert s == (int(hashlib.md5(key.encode()).hexdigest()[:12], 16) / 2**48 < p)


@pytest.mark.parametrize("seed", range(5))
def test_calibration_meets_all_feasible_targets(seed):
    """Against raking by bisection, on cells that hold a feasible mixture."""
    from tracelode.llm import mixing

    rng = np.random.default_rng(seed)
    labels = [np.repeat(np.arange(4), 15), np.tile(np.repeat(np.arange(3), 5), 4), np.tile(np.arange(5), 12)]
    tokens = rng.lognormal(5, 2, 60)
    true = np.minimum(1, np.exp(rng.normal(-1, 1, 4))[labels[0]] * np.exp(rng.normal(0, 1, 3))[labels[1]])
    fraction = (true * tokens).sum() / tokens.sum()
    shares = [np.bincount(lab, true * tokens) / (true * tokens).sum() for lab in labels]
    p, residual = mixing.calibrate(tokens, labels, shares, fraction, rounds=5000)
    assert residual < 1e-5 and (p <= 1).all() and (p > 0).all()
    for lab, share in zip(labels, shares, strict=True):
        assert np.allclose(np.bincount(lab, p * tokens), share * fraction * tokens.sum(), rtol=1e-4)
    rate = np.full(60, fraction)
    for _ in range(300):
        for lab, share in zip(labels, shares, strict=True):
            for v, s in enumerate(share):
                own = lab == v
                rate[own] *= min(bisected(lambda m, o=own: (np.minimum(1, m * rate[o]) * tokens[o]).sum(), s * fraction * tokens.sum()), 1e6)
    assert np.allclose(np.minimum(1, rate), p, atol=2e-3)


def test_language(spark, small, docs):
    got = rows(spark, "/root/testdata/sf0.01", "op2_language_id")
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    known = set(d.lang.dropna())
    right = []
    for i, text, lang in zip(d.doc_id, d.text, d.lang, strict=True):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        letters = isinstance(text, str) and any(c.isalpha() for c in text)
        assert (r.lang_pred in known) if letters else (r.lang_pred == "und")
        if r.held_out and letters and isinstance(lang, str):
            right.append(r.lang_pred == lang)
    assert len(got) == len(d) and np.mean(right) > 0.9


def test_substring(spark, small, docs):
    got = rows(spark, small, "op3_substring_dedup")
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(" ".join(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[" ".join(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), sha(kept))
    assert sum(r.n_removed for r in got.values())


def test_html_keeps_paragraphs_of_articles(spark, small):
    pages = pd.read_parquet(f"{small}/pages.parquet")
    got = rows(spark, small, "op4_html_extraction", "page_id")
    assert set(got) == set(pages.page_id)
    for r in got.values():
        assert r.n_chars == len(r.text)
        assert all(line == line.strip() and line for line in r.text.split("\n")) or r.text == ""
    assert np.mean([r.n_chars > 0 for r in got.values()]) > 0.8


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text):
    n = lambda m: len(re.sub("[^0-9]", "", m))
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n(m) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}


def test_pii(spark, small, docs):
    got = rows(spark, small, "op5_pii")
    some = 0
    for i, t in docs.items():
        want = base_spans(t or "")
        base = [f"{k}:{s}:{e}" for k, v in want.items() for s, e in v]
        assert [got[i][f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        assert got[i].base_sha256 == sha(",".join(base))
        assert set(base) <= set(got[i].spans.split(",")) | ({""} if not base else set())
        some += len(base)
    assert some and set(got) == set(docs)


def test_decontamination(spark, small, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = rows(spark, small, "op6_decontamination")
    bench = pd.read_parquet(f"{small}/benchmark.parquet")
    windows = {}
    for item, t in zip(bench.item_id, bench.text, strict=True):
        w = word.findall(lower(t or ""))
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for i, t in docs.items():
        w, hit, items = word.findall(lower(t or "")), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    items |= found
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(items), sha(",".join(sorted(items))))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert any(r.contaminated for r in got.values())


def exact(docs):
    groups = {}
    for i, t in docs.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    return groups


def test_exact_dedup(spark, small, docs):
    got = rows(spark, small, "op7_exact_dedup")
    for text, ids in exact(docs).items():
        keep = min(ids, key=lambda i: (-len(docs[i] or ""), i))
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(ids), i == keep, sha(text))


def test_chat(spark, small):
    got = rows(spark, small, "op8_chat_formatting", "conv_id")
    talks = pd.read_parquet(f"{small}/conversations.parquet").sort_values(["conv_id", "turn"])
    probe = "</s>[INST] ok [/INST]"
    turns = {-1: [("user", probe), ("assistant", probe)]}
    for c, role, text in zip(talks.conv_id, talks.role, talks.text, strict=True):
        turns.setdefault(int(c), []).append((role, text if isinstance(text, str) else ""))
    assert set(got) == set(turns)
    for c, each in turns.items():
        loss = "".join(t for role, t in each if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(each), sha("".join(f"{a}\n{b}\n" for a, b in each)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > 0


def components(ids, linked):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {i: top(i) for i in ids}


def simhash(text):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(docs):
    fp = {i: simhash(t) for i, t in docs.items()}
    ids = sorted(docs)
    return fp, components(ids, ((a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 3))


def test_simhash(spark, small, docs):
    got = rows(spark, small, "op10_simhash_near_dedup")
    fp, comp = near(docs)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", comp[i]) for i in docs}


def stream(seed, n):
    """Words of SplitMix64, in plain integers."""
    full = (1 << 64) - 1
    for k in range(1, n + 1):
        z = seed + k * 0x9E3779B97F4A7C15 & full
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & full
        z = (z ^ z >> 27) * 0x94D049BB133111EB & full
        yield z ^ z >> 31


def wide(text, n):
    """Bits of a wide fingerprint of n 64-bit words; the lowest byte of a word comes first."""
    w = [x.lower() for x in (text or "").encode().split()]
    if not w:
        return [0] * 64 * n
    grams = [b" ".join(w[k : k + 5]) for k in range(len(w) - 4)] or [b" ".join(w)]
    counts = [0] * 64 * n
    for g in grams:
        for k, z in enumerate(stream(xxhash.xxh64_intdigest(g, seed=42), n)):
            for j in range(64):
                counts[64 * k + j] += z >> (j // 8 * 8 + 7 - j % 8) & 1
    return [int(2 * c > len(grams)) for c in counts]


def similar(docs, width, blocks, reach=48):
    """Components over pairs that share a block and differ in at most ``reach`` of 256 bits; all pairs."""
    bits = {i: np.array(wide(t, -(-width * blocks // 64)), np.uint8) for i, t in docs.items()}
    ids = sorted(docs)
    linked = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k]
        if (bits[a][:256] != bits[b][:256]).sum() <= reach and (bits[a][: width * blocks] == bits[b][: width * blocks]).reshape(blocks, width).all(axis=1).any()
    ]
    return components(ids, linked)


def test_similar_groups_by_brute_force(spark, small, docs):
    from tracelode.llm import simhash

    some = {i: t for i, t in docs.items() if t is None or len(t) < 1500}
    base = [t for t in some.values() if t and 80 < len(t.split())][:8]
    for n, t in enumerate(base):  # near copies with one to eight words changed
        w = t.split()
        for c in range(1, 9):
            some[10_000 + 10 * n + c] = " ".join(f"x{k}" if k % (len(w) // c) == 3 else x for k, x in enumerate(w))
    table = spark.createDataFrame(list(some.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(table).collect()}
    assert simhash.plan(len(some)) == (20, 67)
    assert got == similar(some, 20, 67)
    shingles = lambda t: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    close = far = 0
    for n, t in enumerate(base):
        own = next(i for i in some if some[i] == t)
        for c in range(1, 9):
            a, b = shingles(t.lower()), shingles(some[10_000 + 10 * n + c].lower())
            if len(a & b) / len(a | b) >= 0.8:
                close += 1
                far += got[own] != got[10_000 + 10 * n + c]
    assert close > 10 and far <= 0.15 * close


@pytest.mark.parametrize("n", [1, 10**5, 10**7, 10**10])
def test_blocks_reach_similar_pairs(n):
    """The stated probability, by drawing pairs whose bits differ as those of similarity 0.8 do."""
    from tracelode.llm import simhash

    width, blocks = simhash.plan(n)
    assert 2**width >= n
    miss = np.arccos(2 * 0.8 / 1.8) / np.pi
    rng = np.random.default_rng(5)
    shared = [(rng.random((blocks, width)) >= miss).all(axis=1).any() for _ in range(2000)]
    assert np.mean(shared) > 0.9


def windowed(text, windows):
    """Whether a full benchmark window of 13 words occurs."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return any(tuple(w[k : k + 13]) in windows for k in range(len(w) - 12))


def test_pipeline_stages_by_brute_force(spark, small):
    """Each stage on its own input: what goes is what the brute-force version drops."""
    from tracelode.llm import mixing, simhash
    from tracelode.llm.common import materialize

    bench = pd.read_parquet(f"{small}/benchmark.parquet").text.dropna()
    windows = set()
    for t in bench:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        assert len(w) >= 13
        windows |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    now = spark.read.parquet(f"{small}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        out = materialize(stage(spark, now, small), "test-" + name)
        got = out.collect()
        after = {r.doc_id for r in got}
        assert out.columns == columns and len(got) == len(after) and after <= set(before)
        if name == "language_id":
            assert after == {i for i, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            assert after == {min(ids, key=lambda i: (-len(before[i] or ""), i)) for ids in exact(before).values()}
        elif name == "near_dedup":
            assert after == set(similar(before, *simhash.plan(len(before))).values())
        elif name == "decontamination":
            assert after == {i for i, t in before.items() if not windowed(t, windows)} and len(after) < len(before)
        elif name == "mixing":
            # mix() itself is held against raking by bisection above
            assert after == {r.doc_id for r in mixing.mix(now).where("selected").collect()} and 0 < len(after) < len(before)
        now = out
