"""HTML extraction against an independent version on random pages, pages without an article, and time on malformed ones."""

import random
import time
from html.parser import HTMLParser

import pytest

from tracelode.llm import html_text

NOISE = {"nav", "footer", "aside", "form", "header"}


class Blocks(HTMLParser):
    """Lines of a well-formed page by the standard library's parser: [text, link characters, in article, boilerplate]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines, self.fresh = [], [], True

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, dict(attrs)))
        self.fresh |= tag in html_text.BLOCKS

    def handle_endtag(self, tag):
        self.open.pop()
        self.fresh |= tag in html_text.BLOCKS

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if {"script", "style"} & set(tags):
            return
        noise = bool(NOISE & set(tags)) or any(a.get("class") in ("ad", "comments") for _, a in self.open)
        if self.fresh:
            self.lines.append(["", 0, False, False])
            self.fresh = False
        line = self.lines[-1]
        line[0] += data
        line[1] += len("".join(data.split())) if "a" in tags else 0
        line[2:] = ["article" in tags, noise]


def brute(page, window=3, threshold=86):
    parser = Blocks()
    parser.feed(page)
    lines = [(" ".join(t.split()), n, art) for t, n, art, noise in parser.lines if t.strip() and not noise]
    size = [len(t.replace(" ", "")) for t, _, _ in lines]
    plain = [0 if 2 * n > s else s - n for s, (_, n, _) in zip(size, lines, strict=True)]
    art = [4 * s if a else 0 for s, (_, _, a) in zip(size, lines, strict=True)]
    if any(art):
        peak = max(sum(art[max(0, k - window + 1) : k + 1]) for k in range(len(art) + window - 1))
        weight = [x if a else max(0, p - peak) for x, p, (_, _, a) in zip(art, plain, lines, strict=True)]
    else:
        weight = plain
    sums = [sum(weight[max(0, k - window + 1) : k + 1]) for k in range(len(weight) + window - 1)]
    least = min(threshold, max(sums, default=0))
    out = []
    for k, (t, _, _) in enumerate(lines):
        if not weight[k]:
            continue
        lo = hi = k  # the stretch of sums without a zero around this line
        while lo and sums[lo - 1]:
            lo -= 1
        while hi + 1 < len(sums) and sums[hi + 1]:
            hi += 1
        if max(sums[lo : hi + 1]) >= least:
            out.append(t)
    return "\n".join(out)


def words(draw, n):
    return " ".join(draw.choice(["alpha", "beta", "gamma", "delta", "&amp;", "epsilon"]) for _ in range(n))


def some_page(draw, article):
    para = lambda: f"<p>{words(draw, draw.choice([1, 2, 5, 30, 80]))}{draw.choice(['', ' <b>bold</b> end', ' <a href=x>link text</a>'])}</p>"
    menu = lambda: "<div>" + "".join(f"<p><a href=x>{words(draw, 2)}</a></p>" for _ in range(draw.randrange(1, 8))) + "</div>"
    noise = lambda: draw.choice([f"<nav>{para()}</nav>", f"<div class=ad>{para()}</div>", f"<aside>{para() * 5}</aside>", f"<div class=comments>{para() * 3}</div>", "<script>var p = '<p>';</script>"])
    body = lambda: "".join(draw.choice([para, para, para, menu, noise])() for _ in range(draw.randrange(12)))
    text = f"<h1>{words(draw, 4)}</h1>{body()}"
    return f"<html><head><style>p {{}}</style></head><body>{noise()}{menu()}{body()}" + (f"<article>{text}</article>" if article else f"<div>{text}</div>") + f"{menu()}{body()}<footer>{words(draw, 20)}</footer></body></html>"


@pytest.mark.parametrize("article", [True, False])
def test_random_pages(article):
    draw = random.Random(11)
    for _ in range(300):
        page = some_page(draw, article)
        assert html_text.main_text(page) == brute(page), page


def test_the_distribution_decides_on_pages_without_article():
    long = words(random.Random(1), 40)
    menu = "".join(f"<li><a href=/{k}>item {k}</a></li>" for k in range(9))
    page = f"<body><ul>{menu}</ul><div><p>{long}</p><p>Short.</p><p>{long}</p></div><ul>{menu}</ul><p>Lone line</p><ul>{menu}</ul></body>"
    kept = html_text.main_text(page).split("\n")
    assert len(kept) == 3 and kept[1] == "Short."
    # a small article element does not outweigh the text of the page
    teaser = f"<article><p>Read on</p></article><div>{''.join(f'<p>{long}</p>' for _ in range(5))}</div>"
    assert html_text.main_text(teaser).count("\n") == 5


@pytest.mark.parametrize("piece", ["<a ", "<b>x", '<a "', '<a x="', "</i>", "<!--", "<p><b>", "<i></div>", "<title>", "&amp", "<div><i></div>"])
def test_malformed_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 10


def test_broken_tags():
    assert html_text.main_text("a < b and 1<2 <p>c <x y") == "a < b and 1<2\nc <x y"
    assert html_text.main_text('<article><p title="never closed>one</p><p>two</p></article>') == "one\ntwo"
    assert html_text.main_text("<p title=it's>one</p><p>it's two</p>") == "one\nit's two"
    assert html_text.main_text('<p title="a > b">one</p>') == "one"
    assert html_text.main_text("<p>kept<script>lost") == "kept"
