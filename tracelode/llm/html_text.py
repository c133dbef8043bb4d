"""Main text of web pages by line-block distribution.

The markup is stripped into lines, one for each block of the page, each with
what is known of it: its text length, how much of that is link text, whether
it lies inside an article region, and whether an enclosing element marks it as
boilerplate (menu, header, footer, sidebar, notice, advert, form, script,
style, comments).  Boilerplate goes with the markup.  The text lengths of the
other lines, weighted by the evidence of links and article regions, are summed
over a sliding window of ``window`` lines; a surge is where the sums rise to
the threshold, a dive where they fall to nothing, and the text between them is
kept.

Defined results: a null or empty page has empty text; broken markup is read
the way browsers recover (unclosed blocks end where the next begins; stray end
tags are ignored; a value whose quote never closes ends with its tag; a tag
that never ends is text); a very long page is read whole, in linear time; a
page of short lines only has those of its fullest windows; repeated rows get
equal results; a null id or url stays null; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and markers.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
BOILERPLATE = frozenset("nav header footer aside form head button select dialog menu svg object audio video canvas".split())
REGIONS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted related "
    "replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: A class that also names the text itself is not taken as a mark.
OWN = frozenset("article body content entry main post story text title".split())
#: Elements that an opening tag of the key ends.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: An opening or closing tag whose quoted values close. A value that does not close ends with the tag.
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
#: One where no such tag ends.
_PLAIN_TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)([^>]*+)>")
#: One attribute, name and value, as browsers read them: the next starts where it ends.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[^A-Za-z]+")
#: How many times as much a line inside a declared article counts.
REGION = 4


@dataclass
class Line:
    """One block of a page: its text and what its elements say of it."""

    region: bool
    noise: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _is_noise(name: str, attributes: str) -> bool:
    if name in BOILERPLATE:
        return True
    seen = set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in seen:  # of a repeated attribute the first holds
            continue
        seen.add(key)
        if key in ("hidden", "aria-hidden"):
            if key == "hidden" or value == "true":
                return True
        elif key == "role":
            if value in ROLES:
                return True
        elif key in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _WORD.split(token)}
                if words & MARKS and not words & OWN:
                    return True
    return False


class _Page:
    """The open elements and the lines of a page that is read from front to back."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # name, noise, region: each with what encloses it
        self.at: dict[str, list[int]] = {}  # where in the stack the elements of a name are
        self.blocks: list[int] = []  # where its block elements are
        self.out = [Line(False, False)]

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def fresh(self) -> None:
        noise, region = self.state()
        if self.out[-1].parts:
            self.out.append(Line(region, noise))
        else:
            self.out[-1].region, self.out[-1].noise = region, noise

    def say(self, raw: str) -> None:
        if not raw:
            return
        if (self.out[-1].noise, self.out[-1].region) != self.state():
            self.fresh()
        text = html.unescape(raw)
        self.out[-1].parts.append(text)
        if self.at.get("a"):
            self.out[-1].linked += len("".join(text.split()))

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCKS and self.blocks:
            top = self.stack[self.blocks[-1]][0]
            if top == "p" or top in ENDED_BY.get(name, ()):
                self.close(self.blocks[-1])
        noise, region = self.state()
        noise = noise or _is_noise(name, attributes)
        region = region or name in REGIONS
        if name not in VOID and not attributes.rstrip().endswith("/"):
            self.at.setdefault(name, []).append(len(self.stack))
            if name in BLOCKS:
                self.blocks.append(len(self.stack))
            self.stack.append((name, noise, region))
        if name in BLOCKS:
            self.fresh()

    def end(self, name: str) -> None:
        places = self.at.get(name)
        # an inline end tag does not end the blocks around it
        if places and (name in BLOCKS or not self.blocks or places[-1] > self.blocks[-1]):
            self.close(places[-1])

    def close(self, upto: int) -> None:
        block = False
        while len(self.stack) > upto:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
                block = True
        if block:
            self.fresh()


def lines_of(page: str) -> list[Line]:
    """The blocks of a page in order, without markup; time linear in the page."""
    into, at, tag = _Page(), 0, _TAG
    missing: set[str] = set()  # what does not occur any more

    def past(mark: str, start: int) -> int:
        """Behind the next ``mark``, or the end of the page."""
        k = -1 if mark in missing else page.find(mark, start)
        if k < 0:
            missing.add(mark)
        return len(page) if k < 0 else k + len(mark)

    while (lt := page.find("<", at)) >= 0:
        into.say(page[at:lt])
        at = lt + 1
        head = page[lt + 1 : lt + 9]
        if head.startswith("!--"):
            at = past("-->", lt + 4)
        elif head == "![CDATA[":
            at = past("]]>", lt + 9)
            into.say(html.escape(page[lt + 9 : at].removesuffix("]]>")))
        elif head[:1] in ("!", "?"):
            at = past(">", lt + 2)
        elif not re.match("/?[A-Za-z]", head):
            into.say("<")
        else:
            m = None if ">" in missing else tag.match(page, lt)
            if not m and tag is _TAG:
                # no tag ends outside quotes from here on: from now on one ends at the next >
                tag = _PLAIN_TAG
                m = tag.match(page, lt)
            if not m:
                missing.add(">")
                into.say("<")
                continue
            at, name = m.end(), m[1].lower()
            if head[0] == "/":
                into.end(name)
            elif name == "br":
                into.say(" ")
            elif name in RAW:
                end = None if "</" + name in missing else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                if not end:
                    missing.add("</" + name)
                at = past(">", end.end()) if end else len(page)
            else:
                into.open(name, m[2])
    into.say(page[at:])
    return into.out


def line_weights(lines: list[Line], texts: list[str], window: int) -> np.ndarray:
    """What each line counts in the distribution, with the tags as evidence.

    A line counts by its characters, links left out (a line that is mostly
    links counts nothing).  Where the page declares an article, the article's
    lines count ``REGION`` times, links too, and a line elsewhere counts only
    what it has more than the article's fullest window.
    """
    own = np.array([len(t.replace(" ", "")) for t in texts], np.int64)
    linked = np.minimum([line.linked for line in lines], own)
    region = np.array([line.region for line in lines], bool)
    plain = np.where(2 * linked <= own, own - linked, 0)
    if not (own * region).any():
        return plain
    inside = REGION * own * region
    peak = np.convolve(inside, np.ones(window, np.int64)).max()
    return np.where(region, inside, np.maximum(plain - peak, 0))


def main_lines(lines: list[Line], window: int = 3, threshold: int = 86) -> list[str]:
    """The texts between the surge and dive points of the line-block distribution.

    Boilerplate is markup like any other and is stripped first, so text goes on
    behind it.  The weights of ``window`` lines are summed; a surge point is
    where the sums reach ``threshold`` (or the page's peak, if that is lower),
    a dive point where they have fallen to nothing.  The text is what lies
    between, from the foot of the surge on.
    """
    left = [(line, t) for line in lines if not line.noise and (t := line.text())]
    if not left:
        return []
    texts = [t for _, t in left]
    weights = line_weights([line for line, _ in left], texts, window)
    sums = np.convolve(weights, np.ones(window, np.int64))  # sums[k]: of the lines k - window + 1 .. k
    surge = min(threshold, int(sums.max()))
    keep: list[str] = []
    foot = None
    surged = False
    for k, s in enumerate([*sums.tolist(), 0]):
        if not s:  # a dive
            if surged:
                keep += [texts[i] for i in range(foot, min(k, len(texts))) if weights[i]]
            foot, surged = None, False
            continue
        foot = k if foot is None else foot
        surged = surged or s >= surge
    return keep


def main_text(page: str | None) -> str:
    return "\n".join(main_lines(lines_of(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [main_text(h.as_py()) for h in b.column(2)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
