"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level borders, each with
the elements around it. Features are the ancestors' tags, the words of their class, id and role, and
the text's own look (length, share of links, punctuation, place). The field has two labels, article
and rest, is trained by maximum likelihood (forward-backward) on labelled pages and decoded by Viterbi.

The labelled pages are drawn by `labelled_pages`: layouts of the usual parts under the names that
pages give them, with made-up words, so that only structure and look can be learned.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that end a run of text, that hold no shown text, and that close one another.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot"
    " th thead tr ul button label textarea head title".split()
)
HIDDEN_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video title head".split())
HEAD_TAGS = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

# Attributes of a tag: runs of characters and quoted values. A tag with more of them than that ends at its first ">", so that
# a page of unbalanced quotes is not read again from each of its tags.
_ATTRS = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*'){0,512}+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|textarea)\b(?:{_ATTRS})>(?P<rawtext>.*?)(?:(?P<rawend></(?P=raw)\s*>)|\Z)"
    rf"|</?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_UNCLOSED = re.compile(r"<!--|<!\[CDATA\[")
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDING = re.compile(r"hidden|style", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([\w-]+)", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A run of text: its innermost block-level element, all of those around it, the names around it, and its share of links."""

    text: str
    inner: str
    under: frozenset[str]
    names: frozenset[str]
    linked: float


class _Stack:
    """Open elements. What a block needs of them is counted on push and pop, so a tag costs the same at any depth."""

    def __init__(self, known: frozenset[str] | None):
        self.known = known
        self.open: list[tuple[str, frozenset[str], bool]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[str] = []
        self.under: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.hidden = 0

    def push(self, tag: str, names: frozenset[str], hidden: bool) -> None:
        names = names if self.known is None else names & self.known
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, names, hidden))
        self.hidden += hidden
        if tag in BLOCK_TAGS:
            self.blocks.append(tag)
            self.under[tag] = self.under.get(tag, 0) + 1
        for n in names:
            self.names[n] = self.names.get(n, 0) + 1

    def pop(self) -> None:
        tag, names, hidden = self.open.pop()
        self.at[tag].pop()
        self.hidden -= hidden
        if tag in BLOCK_TAGS:
            self.blocks.pop()
            _less(self.under, tag)
        for n in names:
            _less(self.names, n)

    def last(self, tags: frozenset[str] | set[str] | tuple[str, ...]) -> int:
        """Place of the last open element of any of these tags, -1 if there is none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)


def _less(counts: dict[str, int], key: str) -> None:
    counts[key] -= 1
    if not counts[key]:
        del counts[key]


def _hides(attrs: str) -> bool:
    """Whether there is an attribute named hidden, or a style whose last display is none. Of equal names the first counts."""
    if not _HIDING.search(attrs):
        return False
    values: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        if m[1]:
            values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    shown = _DISPLAY.findall(re.sub(r"/\*.*?\*/", " ", html.unescape(values.get("style", "")), flags=re.DOTALL))
    return "hidden" in values or bool(shown) and shown[-1].lower() == "none"


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Blocks with text, in page order. Texts are decoded, their white space collapsed and trimmed.

    `known`: the names that blocks keep, of all that are around them (None: every one).
    """
    blocks: list[Block] = []
    stack = _Stack(known)
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                inner = stack.blocks[-1] if stack.blocks else ""
                blocks.append(Block(text, inner, frozenset(stack.under), frozenset(stack.names), min(1.0, linked / len(text))))
            pieces.clear()
            linked = 0

    def pop(to: int) -> None:
        if any(tag in BLOCK_TAGS for tag, _, _ in stack.open[to:]):
            flush()
        while len(stack.open) > to:
            stack.pop()

    def close_head() -> None:
        while stack.open and stack.open[-1][0] == "head":
            pop(len(stack.open) - 1)

    def add(text: str) -> None:
        nonlocal linked
        if stack.hidden and text.strip():
            close_head()  # text can't stand in head
        if text and not stack.hidden:
            pieces.append(text)
            if stack.at.get("a"):
                linked += len(text.strip())

    # No tag ends behind the last ">": what follows is text, or the rest of what the last token left open.
    end = page.rfind(">") + 1
    rest = _UNCLOSED.split(page[end:], maxsplit=1)[0]
    at = 0
    for m in _TOKEN.finditer(page, 0, end):
        add(page[at : m.start()])
        at = m.end()
        if at == end and (m["raw"] and not m["rawend"] or m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>")):
            rest = ""
        if m["raw"]:
            if m["raw"].lower() == "textarea":
                close_head()
                flush()
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if page[m.start() + 1] == "/":
            if (place := stack.last((tag,))) >= 0:
                pop(place)
            elif tag == "p":
                flush()
            continue
        if tag not in HEAD_TAGS:
            close_head()
        if tag == "br":
            if not stack.hidden:
                pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            # An open paragraph ends where a block begins; items end where the next begins.
            if stack.blocks and stack.blocks[-1] == "p":
                pop(stack.last(("p",)))
            if tag in CLOSES and (place := stack.last(CLOSES[tag])) > stack.last(FENCES[tag]):
                pop(place)
            flush()
        if tag in VOID_TAGS or m["attrs"].endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag == "body":
            pop(0 if not stack.open or stack.open[0][0] != "html" else 1)
        names = frozenset(w.lower() for v in _NAMES.findall(m["attrs"]) for w in _WORDS.findall(max(v))) if m["attrs"] else frozenset()
        stack.push(tag, names, tag in HIDDEN_TAGS or bool(m["attrs"] and _hides(m["attrs"])))
    add(page[at:end] + rest)
    flush()
    return blocks


#: Names that a page's own article usually stands under.
_MAIN = frozenset("article main content entry post story".split())


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    n = len(blocks)
    inside = [not (_MAIN.isdisjoint(b.under) and _MAIN.isdisjoint(b.names)) for b in blocks]
    some = any(inside)
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        own = ["bias", f"in {b.inner or 'nothing'}", f"words {min(6, int(math.log2(words)))}", f"links {0 if b.linked == 0 else 1 + int(b.linked * 2.99)}"]
        where = "inside" if inside[k] else "outside" if some else "nowhere"
        own += [where, f"{where} {b.inner}"]
        own += [f"under {t}" for t in b.under]
        own += [f"named {x}" for x in b.names]
        own.append(f"ends {b.text[-1] if b.text[-1] in '.!?:,' else 'x'}")
        if b.text[-1] in ".!?" and words > 8 and b.linked < 0.3:
            own.append("a sentence")
        if "©" in b.text:
            own.append("copyright sign")
        own.append(f"place {min(2, 3 * k // max(1, n))}")
        out.append(own)
    return out


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _expected(score: list[list[float]], pair: list[list[float]]) -> tuple[list[list[float]], list[list[float]]]:
    """Probability of each label at each block, and expected number of each pair of neighbouring labels, by forward and backward sums."""
    n = len(score)
    (p00, p01), (p10, p11) = pair
    forward = [tuple(score[0])]
    for s0, s1 in score[1:]:
        f0, f1 = forward[-1]
        forward.append((s0 + _log_sum(f0 + p00, f1 + p10), s1 + _log_sum(f0 + p01, f1 + p11)))
    backward = [(0.0, 0.0)]
    for s0, s1 in reversed(score[1:]):
        b0, b1 = backward[-1]
        z0, z1 = s0 + b0, s1 + b1
        backward.append((_log_sum(p00 + z0, p01 + z1), _log_sum(p10 + z0, p11 + z1)))
    backward.reverse()
    total = _log_sum(*forward[-1])
    node = [[math.exp(f0 + b0 - total), math.exp(f1 + b1 - total)] for (f0, f1), (b0, b1) in zip(forward, backward, strict=True)]
    pairs = [[0.0, 0.0], [0.0, 0.0]]
    for k in range(1, n):
        for a in (0, 1):
            for b in (0, 1):
                pairs[a][b] += math.exp(forward[k - 1][a] + pair[a][b] + score[k][b] + backward[k][b] - total)
    return node, pairs


@dataclass
class Field:
    """Weights of features by label, and of label pairs. Label 1 is the article."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    pairs: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        none = (0.0, 0.0)
        get, ((p00, p01), (p10, p11)) = self.weights.get, self.pairs
        a = b = 0.0
        back = []
        for k, row in enumerate(rows):
            s0 = s1 = 0.0
            for f in row:
                w = get(f, none)
                s0 += w[0]
                s1 += w[1]
            if k:
                x0, y0, x1, y1 = a + p00, b + p10, a + p01, b + p11
                back.append((x0 < y0, x1 < y1))
                a, b = max(x0, y0) + s0, max(x1, y1) + s1
            else:
                a, b = s0, s1
        labels = [int(b > a)] if rows else []
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    @functools.cached_property
    def known(self) -> frozenset[str]:
        """The names that have a weight or a meaning of their own."""
        return frozenset(f.removeprefix("named ") for f in self.weights if f.startswith("named ")) | _MAIN

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 5, ridge: float = 1e-4) -> Field:
        """Maximum likelihood by Adagrad over pages; expectations by forward and backward sums."""
        names = sorted({f for rows, _ in pages for row in rows for f in row})
        number = {f: k for k, f in enumerate(names)}
        w, pair = np.zeros((len(names), 2)), np.zeros((2, 2))
        w_sum, pair_sum = np.full(w.shape, 1e-6), np.full(pair.shape, 1e-6)
        coded = [([np.array([number[f] for f in row]) for row in rows], np.array(y)) for rows, y in pages]
        flats = [(np.concatenate(rows), np.array([len(x) for x in rows])) if rows else None for rows, _ in coded]
        random = np.random.Generator(np.random.PCG64(3))
        for _ in range(epochs):
            for page in random.permutation(len(coded)):
                rows, y = coded[page]
                n = len(rows)
                if not n:
                    continue
                flat, sizes = flats[page]
                score = np.add.reduceat(w[flat], np.cumsum(sizes) - sizes, axis=0).tolist()
                node, pair_gap = _expected(score, pair.tolist())
                gap = np.array(node) - np.eye(2)[y]
                pair_gap = np.array(pair_gap)
                np.subtract.at(pair_gap, (y[:-1], y[1:]), 1)
                at, inverse = np.unique(flat, return_inverse=True)
                each = np.repeat(gap, sizes, axis=0)
                grad = np.stack([np.bincount(inverse, each[:, k], len(at)) for k in (0, 1)], axis=1)
                grad += ridge * w[at]
                w_sum[at] += grad**2
                w[at] -= 0.3 * grad / np.sqrt(w_sum[at])
                pair_sum += pair_gap**2
                pair -= 0.3 * pair_gap / np.sqrt(pair_sum)
        return cls({f: (float(w[k, 0]), float(w[k, 1])) for f, k in number.items()}, tuple(map(tuple, pair.tolist())))  # type: ignore[arg-type]


# The names that pages give to their parts.
ARTICLE = ["<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post entry">', '<section class="article-body">', '<div class="story">', '<main><article>', '<div itemprop="articleBody">', '<div class="entry-content text">', '<div role="main">']
REST = {
    "nav": ["<nav>", '<div class="menu">', '<div id="navigation">', '<ul class="navbar">', '<div role="navigation">', '<div class="breadcrumbs">', '<header><nav>', '<div class="topnav links">'],
    "header": ["<header>", '<div id="header">', '<div class="site-header masthead">', '<div class="topbar">', '<div role="banner">', '<div class="logo branding">'],
    "footer": ["<footer>", '<div id="footer">', '<div class="site-footer">', '<div class="copyright legal">', '<div role="contentinfo">', '<footer class="bottom">'],
    "side": ["<aside>", '<div class="sidebar">', '<div class="widget">', '<div id="right-rail">', '<div class="related recommended">', '<aside class="promo">', '<div class="trending popular">', '<div role="complementary">', '<div class="secondary column">'],
    "ad": ['<div class="ad">', '<div class="ads banner">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div id="ad-slot">', '<ins class="adsbygoogle">', '<div class="promo promotion">', '<p class="ad">', '<section class="ads">'],
    "notice": ['<div class="cookie-notice">', '<div class="notice">', '<div class="alert warning">', '<div class="consent banner">', '<div id="gdpr">', '<dialog>', '<div class="popup modal">', '<p class="notice">', '<div class="message disclaimer">', '<div role="alert">'],
    "form": ["<form>", '<form class="search">', '<div class="newsletter subscribe"><form>', '<form id="login">', "<form><fieldset>", '<div class="signup">'],
    "comments": ['<section class="comments">', '<div id="comments">', '<ol class="comment-list">', '<div class="discussion replies">', '<div class="comment">', '<section id="responses">', '<div class="reader-comments">', '<div id="disqus">'],
    "share": ['<div class="share">', '<ul class="social">', '<div class="tags meta">', '<div class="toolbar tools">', '<div class="pagination pager">', '<div class="author-bio about">'],
}


def labelled_pages(count: int = 600, seed: int = 1) -> list[tuple[str, str]]:
    """Pages with their article texts, made from the parts above. Words are made up; lengths overlap between parts."""
    r = np.random.Generator(np.random.PCG64(seed))
    syllables = [a + b for a in "b d f g k l m n p r s t v z ch sh th qu".split() for b in "a e i o u an en in on ar er ai ou é ü".split()]
    pick = lambda options: options[int(r.integers(0, len(options)))]
    word = lambda: "".join(pick(syllables) for _ in range(int(r.integers(1, 4))))

    def sentence(words: int) -> str:
        return (" ".join(word() for _ in range(words))).capitalize() + str(pick([".", ".", ".", ".", "!", "?", "", ":", " &amp;&amp;&amp;", "!!", "###"]))

    def prose(most: int) -> str:
        return " ".join(sentence(int(r.integers(1, 14))) for _ in range(int(r.integers(1, most + 1))))

    def close(opening: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n)) + "</ul>"

    def rest(kind: str) -> str:
        opening = str(pick(REST[kind]))
        style = int(r.integers(0, 4))
        body = {"nav": links(int(r.integers(2, 8))), "share": " ".join(f"<a href='#'>{word()}</a>" for _ in range(3)), "form": f"<label>{word()}</label><input name=q><select><option>{word()}<option>{word()}</select><button>{word()}</button><p>{prose(1)}</p>"}.get(kind)
        if body is None or style == 3 and kind in ("share",):
            body = [prose(2), f"<p>{prose(3)}</p>" * 1 + f"<p>{prose(3)}</p>", f"<h3>{sentence(3)}</h3>{links(3)}", f"<p>{prose(2)}</p>"][style]
        if kind == "comments":
            body = f"<h2>{word()}</h2>" + "".join(f'<div class="comment"><b>{word()}</b><p>{prose(4)}</p></div>' if style % 2 else f"<li><p>{prose(4)}</p></li>" for _ in range(int(r.integers(1, 4))))
        if kind == "footer" and style < 2:
            body = f"&copy; {word()}.example &middot; {prose(1)}"
        return opening + body + close(opening)

    pages = []
    for _ in range(count):
        truth: list[str] = []

        def shown(markup: str) -> str:
            text = " ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in markup else "", markup)).split())
            if text:
                truth.append(text)  # noqa: B023
            return markup

        def part(inside: bool = True) -> str:
            kind = pick(["p", "p", "p", "p", "bold", "h2", "li", "quote", "div", "table", "pre", "figure", "dl"]) if inside else "p"
            text = lambda most=5: shown(prose(most))
            if kind == "bold":
                return f"<p><b>{text(2)}<br>"
            if kind == "li":
                return "<ul>" + "".join(f"<li>{text(2)}</li>" for _ in range(int(r.integers(1, 4)))) + "</ul>"
            if kind == "table":
                return f"<table><tr><td>{text(1)}</td><td>{text(1)}</td></tr></table>"
            if kind == "dl":
                return f"<dl><dt>{text(1)}<dd>{text(2)}</dl>"
            if kind == "figure":
                return f"<figure><img src=x><figcaption>{text(1)}</figcaption></figure>"
            opening = {"p": "<p>", "h2": "<h2>", "quote": "<blockquote><p>", "div": "<div>", "pre": "<pre>"}[str(kind)]
            if kind == "p" and r.random() < 0.25:
                return "<p>" + shown(f'{prose(2)} <a href="/x">{word()} {word()}</a> <em>{word()}</em> {prose(1)}') + ("</p>" if r.random() < 0.8 else "")
            return opening + text() + close(opening)

        opening = str(pick(ARTICLE)) if r.random() < 0.8 else str(pick(["", "<div>", f'<div class="{word()}">']))
        inner = []
        if r.random() < 0.85:
            title = f"<h1>{shown(sentence(int(r.integers(1, 9))))}</h1>"
            inner.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(int(r.integers(0, 14))):
            inner.append(part())
            if r.random() < 0.06:
                inner.append(rest(str(pick(["ad", "side", "share", "notice", "form"]))))
        article = opening + "".join(inner) + close(opening)
        kinds = list(REST)
        before = [rest(k) for k in ("header", "nav", "notice", "ad", "side", "form") if r.random() < (0.8 if k == "nav" else 0.35)]
        after = [rest(k) for k in ("share", "ad", "comments", "side", "form", "notice", "nav", "footer") if r.random() < (0.8 if k == "footer" else 0.35)]
        assert kinds
        page = f"<!DOCTYPE html><html><head><title>{sentence(4)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>" + "".join(before) + article + "".join(after) + "</body></html>"
        if r.random() < 0.3:
            page = page.replace("<body>", '<body><div class="wrapper container">').replace("</body>", "</div></body>")
        pages.append((page, "\n".join(truth)))
    return pages


def _labels(blocks: list[Block], truth: str) -> list[int]:
    """Labels of a labelled page: its article's lines, in order, are the blocks labelled 1."""
    lines, k, out = truth.split("\n") if truth else [], 0, []
    for b in blocks:
        hit = k < len(lines) and b.text == lines[k]
        k += hit
        out.append(int(hit))
    return out


@functools.lru_cache(maxsize=2)
def trained(count: int = 600, seed: int = 1) -> Field:
    """The field of the pages of `labelled_pages`: fitted once in a process, the same in each."""
    pages = []
    for page, truth in labelled_pages(count, seed):
        blocks = leaf_blocks(page)
        pages.append((features(blocks), _labels(blocks, truth)))
    return Field.fit(pages)


def main_text(page: str | None, model: Field) -> str:
    if not page:
        return ""
    blocks = leaf_blocks(page, model.known)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """Out: page_id, url, text (never null), n_chars. Null and empty pages have an empty text.

    The whole page is read. Rows are independent; other columns are not looked at.
    """
    model = model or trained()
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.pairs))  # as large as the labelled pages' vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(p.as_py(), own) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
