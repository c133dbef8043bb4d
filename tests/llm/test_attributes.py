"""Only whole attribute names of a tag mark its element as boilerplate."""

import pytest

from tracelode.llm import html_text

KEPT = [
    'style="overflow: hidden"', "style='overflow:hidden'", 'title="hidden gems, class=ads id=menu"', 'data-hidden="1"', "data-hidden",
    'data-id="comments-12"', 'data-class="ads"', 'data-role=navigation', 'x-id="sidebar"', 'aria-hidden="false"', "title=hidden", 'class="story" class="ads"',
    'href="/a?id=menu&hidden=1"', 'alt = "role=banner"', "",
]
GONE = [
    "hidden", "HIDDEN", 'hidden=""', "hidden=until-found", 'aria-hidden="true"', 'role="navigation"', "role = banner", 'class="ads"', "class=ads",
    "id='comments-12'", 'style="color: red"hidden', 'title="it\'s" class = "sidebar"', 'data-x="1"/hidden',
]


@pytest.mark.parametrize("attributes", KEPT + GONE)
def test_marks(attributes):
    assert html_text._is_noise("div", " " + attributes) == (attributes in GONE)


def test_pages_with_such_attributes(spark):
    text = "This paragraph is the text of the page and has to stay in full."
    pages = [(k, "u", f"<html><body><div {a}><article><p>{text}</p></article></div></body></html>") for k, a in enumerate(KEPT + GONE)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == {k: text if a in KEPT else "" for k, a in enumerate(KEPT + GONE)}
