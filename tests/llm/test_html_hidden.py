"""Which elements of a page are hidden."""

from __future__ import annotations

import pytest

from brindle.llm import html_crf


@pytest.mark.parametrize(
    "attrs",
    ['aria-hidden="false"', "data-hidden=0", 'style="overflow:hidden;border:none"', 'class="hidden"', "class=hidden", 'style="display:none;display:block"', 'title="display:none"'],
)
def test_shown(attrs):
    assert [b.text for b in html_crf.leaf_blocks(f"<body><article {attrs}><p>a text</p></article>")] == ["a text"]


@pytest.mark.parametrize("attrs", ["hidden", 'hidden=""', "id=x HIDDEN", 'style="color:red; Display : none"', "style=display:none", "style='display:none!important'"])
def test_hidden(attrs):
    assert html_crf.leaf_blocks(f"<body><div {attrs}><p>a text</p></div>") == []


def test_head_without_end():
    for head in ("<html><head><title>t</title><meta charset=x>", "<head><title>a <b>t</b></title><script>x</script>"):
        assert [b.text for b in html_crf.leaf_blocks(head + "<p>one</p><p>two</p>")] == ["one", "two"]
        assert [b.text for b in html_crf.leaf_blocks(head + "bare")] == ["bare"]
        assert [b.text for b in html_crf.leaf_blocks(head + "</head><body><p>one")] == ["one"]
