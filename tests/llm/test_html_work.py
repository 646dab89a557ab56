"""Work on a page grows with its length, whatever is nested or left open."""

from __future__ import annotations

import time

import pytest

from brindle.llm import html_crf

PAGES = {
    "nested divs": "<div class='a b'>x" * 100_000,
    "blocks under inline elements": "<b>" * 40_000 + "<div>y</div>" * 40_000,
    "ends of what isn't open": "<div>" * 50_000 + "</span>" * 50_000,
    "items under blocks": "<div>" * 50_000 + "<li>x" * 50_000,
    "tags without an end": "<a " * 100_000,
    "unbalanced quotes": '<a " > " ' * 30_000,
    "other names at each depth": "".join(f"<div class=n{i}q>t" for i in range(40_000)),
    "open comments": "<!-- a > " * 50_000,
    "open scripts": "<script>" * 50_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_work(name):
    model = html_crf.Field({"bias": (0.0, 1.0), "named a": (0.0, 1.0)})
    began = time.perf_counter()
    html_crf.main_text(PAGES[name], model)
    assert time.perf_counter() - began < 10


def test_features_read_the_whole_block():
    far = "word " * 500
    blocks = html_crf.leaf_blocks(f"<p>{far}© someone</p><p>{far}</p>")
    assert ["copyright sign" in f for f in html_crf.features(blocks)] == [True, False]
    assert blocks[0].inner == "p" and blocks[0].under == {"p"}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<!-- b > c", ["a"]),
        ("<p>a<script>var x = '</p>'; y", ["a"]),
        ("<p>a<![CDATA[ b > c", ["a"]),
        ("<p>a</p>b <!-- c", ["a", "b"]),
        ("<p>1 < 2 and a <b", ["1 < 2 and a <b"]),
        ("no tag at all", ["no tag at all"]),
        ("<ul><li>a<div>b<li>c</ul>d", ["a", "b", "c", "d"]),
        ("<ul><li>a<ul><li>b</ul>c<li>d", ["a", "b", "c", "d"]),
        ("<p>a<b>b<div>c</div>d", ["ab", "c", "d"]),
        ("<p>a<b>b<p>c", ["ab", "c"]),
    ],
)
def test_open_ends(page, want):
    assert [b.text for b in html_crf.leaf_blocks(page)] == want


def test_known_names_change_no_label():
    model = html_crf.trained()
    for page, _ in html_crf.labelled_pages(40, seed=5):
        every = html_crf.leaf_blocks(page)
        some = html_crf.leaf_blocks(page, model.known)
        assert [b.text for b in every] == [b.text for b in some]
        assert model.decode(html_crf.features(every)) == model.decode(html_crf.features(some))
