"""Main text of web pages as the best-scoring contiguous region.

A page is read as a row of words and tags. Words score positive, by what they
stand in, and tags negative, by their name; a linear scan (largest sum of a
contiguous stretch) finds the content region. The weights come from the
labelled pages below, by a perceptron on whole regions. Containers that tell
what their text is for (by class, id, role or a telling name) are scored by a
logistic regression: in those that score as boilerplate neither words nor tags
count, so an advert does not cut an article in two, and they are left out of
the region; words in those that score as content have a weight of their own,
and where a page has such, words beside them weigh less. Containers that tell
nothing are judged by the scan alone.

Text: character references decoded, white space inside a block made one space,
blocks trimmed and joined by two line breaks, in page order. Elements that are
no blocks, unknown ones among them, do not split a block.

Rows: null and empty html give an empty text; broken markup is read to its end
(an unclosed comment or script swallows the rest, as in browsers); repeated
rows are extracted each; a null page_id or url stays null; extra columns are
ignored; an empty table gives no rows. Ties go to the earliest, then the
longest region.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import pages, prepare

# Fixed values of HTML.
RAW = {"script", "style", "textarea", "title", "template", "iframe", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "listing", "main", "menu", "nav", "ol", "optgroup", "option", "p", "plaintext", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
OPTIONAL_END = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "optgroup", "html", "body", "head"}
#: Elements whose name says what their text is for; of others only class, id and role tell.
TELLING = {"article", "aside", "button", "dialog", "fieldset", "footer", "form", "head", "header", "label", "legend", "main", "menu", "nav", "option", "search", "select"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR_END = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_CLASS = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_TOKEN = re.compile(r"[a-z]{2,}")
IN, OUT = "x-in", "x-out"  # marks of the labelled pages
START = 0.5  # the score of containers that tell nothing
FAINT = 1.2  # features of less weight, names of the layout mostly, tell nothing


def events(page: str):
    """Yield ("text", raw), ("open", name, attributes) and ("close", name) in one pass over the page."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield ("text", page[at:])
            return
        if lt > at:
            yield ("text", page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("</", lt)
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield ("text", "<")
                at = lt + 1
            continue
        name = m.group().lower()
        end = _ATTR_END.match(page, m.end())
        if end:
            stop = end.end()
        else:  # an open quote: the tag ends at the next >
            gt = page.find(">", m.end())
            stop = n if gt < 0 else gt + 1
        attributes = page[m.end(): stop - 1]
        at = stop
        if closing:
            yield ("close", name)
            continue
        yield ("open", name, attributes)
        if name in RAW and not attributes.endswith("/"):
            close = _closer(name).search(page, at)
            at = n if not close else close.start()


@lru_cache(maxsize=64)
def _closer(name: str):
    return re.compile(f"</{name}(?=[\\s/>])", re.I)


def container_features(name: str, attributes: str) -> set[str]:
    """What a container says: its name, if that tells, and the words of its class, id and role."""
    out = {name} if name in TELLING else set()
    if attributes:
        for m in _CLASS.finditer(attributes):
            out |= {f".{t}" for t in _TOKEN.findall(m.group(1).lower())}
        if _HIDDEN.search(attributes):
            out.add(".hidden")
    return out


class Item(NamedTuple):
    """A text or a tag, the score of the containers it stands in, whether they hold a link, and (in training) their features."""

    kind: str
    value: str
    score: float
    link: bool
    features: frozenset


def read_page(page: str, weight: dict[str, float] | None = None) -> list[Item]:
    """The page as a row of texts and tags.

    A feature counts once, however many open containers have it; one that a
    labelled page has within an article or main has a weight of its own there.
    What speaks against a container is not outweighed by those around it. With
    no weights, as in training, items carry the features themselves.
    """
    items: list[Item] = []
    stack: list[tuple] = []  # name, features that opened with it, score and link before it
    where: dict[str, list[int]] = {}  # places of open elements by name
    live: set[str] = set()
    score, link, none = START, False, frozenset()

    def note(kind, value):
        items.append(Item(kind, value, score, link, none if weight is not None else frozenset(live)))

    def close_from(i):
        nonlocal score, link
        score, link = stack[i][2:]
        for name, own, _, _ in stack[i:]:
            where[name].pop()
            live.difference_update(own)
        del stack[i:]

    for e in events(page):
        if e[0] == "text":
            if not (stack and stack[-1][0] in RAW):
                note("text", e[1])
            continue
        name = e[1]
        if e[0] == "open":
            if name in VOID or name in (IN, OUT):
                note("tag", name)
                continue
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and where.get(name):
                i = where[name][-1]
                if all(x[0] in OPTIONAL_END or x[0] == "a" for x in stack[i:]):
                    close_from(i)
            own = container_features(name, e[2])
            if "article" in live or "main" in live:
                own = {f"in:{f}" for f in own if weight is None or f"in:{f}" in weight} | {f for f in own if weight is not None and f"in:{f}" not in weight}
            own -= live
            where.setdefault(name, []).append(len(stack))
            stack.append((name, own, score, link))
            live |= own
            if weight is not None:
                told = sum(weight.get(f, 0.0) for f in sorted(own))
                score = told + (min(score, START) if told < 0 else score)
            link = link or name == "a"
            note("tag", name)
        else:
            note("tag", name)
            if where.get(name):
                i = where[name][-1]
                if name in BLOCK and name not in OPTIONAL_END or all(x[0] in OPTIONAL_END or x[0] not in BLOCK for x in stack[i + 1:]):
                    close_from(i)
    return items


# Labelled pages: the text between [[ and ]] is the article; {{ and }} enclose what in it is none of it.
LABELLED = [
    """<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now and save</div><article>[[<h1>A title here</h1><p>Some words of the text go on.</p><p><b>More words<br>follow.</p>]]</article><footer>&copy; site and some rights</footer></body></html>""",
    """<body><header><h1>Site name</h1><div class="menu"><a href="/">Home</a> <a href="/x">About us</a></div></header><div id="cookie-notice" class="notice banner">We use cookies on this site. <button>Accept</button></div><main>[[<h1>Words of a title</h1><p>First part of it.</p><p>And a second part, longer than the first.</p>]]</main><aside class="sidebar"><h2>Related</h2><ul><li><a href="/1">One story</a></li></ul></aside><footer><p>Terms and contact</p></footer></body>""",
    """<body><div class="header"><a href="/">Logo</a></div><div class="content">[[<h2>Headline</h2><p>A story begins.</p>{{<div class="ad sponsored">Sponsored words here</div>}}<p>It ends here.</p><blockquote>Said someone.</blockquote>]]</div><div class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>I like this very much indeed.</p></div><form><p>Leave a reply</p><label>Name</label></form></div><div class="footer">All rights reserved</div></body>""",
    """<body><nav class="navbar"><a href="/">A</a><a href="/">B</a></nav><section class="post article">[[<h1>One more</h1><p>Words words {{<span class="ad promo">buy this</span>}} and more.</p><ul><li>First point</li><li>Second point</li></ul><table><tr><td>Cell</td></tr></table><pre>code here</pre>]]</section><div class="newsletter subscribe signup"><form><p>Sign up to our letter today</p></form></div><div class="related recommended"><a href="/r">Read more of this</a></div><div class="share social"><a href="/s">Share it</a></div></body>""",
    """<body><div class="advert promo">Great offers this week only</div><div class="breadcrumb breadcrumbs"><a href="/">Home</a> / <a href="/x">Part</a></div><article class="entry">[[<header><h1>Its title</h1></header><p>The body of the text is here and it is long.</p><figure><figcaption>What the picture shows</figcaption></figure><section><h2>Part two</h2><p>More of it.</p></section>]]</article><section class="comments replies"><article class="comment"><p>First comment by a reader.</p></article></section><div role="contentinfo" class="copyright legal">Imprint</div><div class="popup modal overlay alert gdpr consent">Please agree</div></body>""",
    """<body><div class="pagination pager"><a href="/2">Next page</a></div><div role="navigation" class="toc"><a href="#1">Part one</a></div><div role="complementary" class="widget">Weather today is fine</div><div class="main body text story">[[<p>Only one paragraph.</p><h3>And a head</h3><dl><dt>Term</dt><dd>What it means</dd></dl>]]</div><div class="disclaimer">No liability taken</div><div class="hidden" style="display:none">Not seen</div><div class="login search"><form><label>Password</label></form></div><div class="ads adsbygoogle advertisement">Click here to win</div></body>""",
    """<body><div><a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact us</a></div><div>[[<p>This page has no names on its parts, only a text of some length in a few paragraphs.</p><p>This is the second of them, and it goes on a little.</p><p>The last.</p>]]</div><div><a href="/i">Imprint</a> <a href="/p">Privacy</a></div></body>""",
    """<body>[[<h1>Plain title</h1><p>A plain page is all text and nothing else around it.</p><ul><li>One</li><li>Two</li></ul><p>It ends.</p>]]</body>""",
    """[[Words without any tag round them]]""",
    """<html><body><table><tr><td><a href="/a">Alpha</a><br><a href="/b">Beta</a><br><a href="/c">Gamma</a></td><td>[[<h1>Old page</h1><p>Pages were once laid out by tables, with the text in one cell of it.</p><p>So is this one.</p>]]</td></tr></table></body></html>""",
    """<body><ul><li><a href="/1">First link</a></li><li><a href="/2">Second link</a></li><li><a href="/3">Third link</a></li></ul><div class="x1"><div class="x2">[[<h2>News of the day</h2><div>Here the paragraphs are made of div elements, as many pages have them.</div><div>This one has a <a href="/l">link in it</a> and goes on after it.</div><div>Short one.</div>]]</div></div><ul><li><a href="/4">Fourth link</a></li><li><a href="/5">Fifth link</a></li></ul></body>""",
    """<body><div>Site</div><div><div><a href="/">Start</a></div><div><a href="/b">Blog</a></div></div><div>[[<h1>On trees</h1><p>Trees grow, and a text on them grows with them, from line to line.</p><blockquote>A tree is a tree.</blockquote><h2>More</h2><p>Of their leaves there is much to say, and it is said here.</p><ol><li>Oak</li><li>Elm</li></ol>]]</div><div><div><a href="/t">Terms</a></div><div><a href="/u">Us</a></div></div></body>""",
    """<body><div id="wrapper"><div id="page"><div><a href="/">Home</a></div><div>[[<p>First paragraph of a text whose containers have names that tell little or nothing at all.</p><p>Second paragraph.</p><p>Third paragraph, a bit longer than the one before.</p>]]</div></div></div></body>""",
    """<body><form action="/s"><select><option>English</option></select><button>Go</button></form><article>[[<h1>Title</h1><p>Text with a formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> inside.</p><p>And an end.</p>]]</article><dialog>Please log in</dialog><menu><li>Cut</li></menu></body>""",
    """<body><p><a href="/">Back</a> | <a href="/n">Next</a> | <a href="/u">Up</a></p><h1>[[Chapter one]]</h1></body>""".replace("<h1>[[", "[[<h1>").replace("]]</h1>", "</h1><p>It was a day like any other, and then it was not. He went out to see.</p><p>Nobody was there.</p><p>He came back.</p>]]"),
    """<body><div class="nav menu links"><ul><li>Start</li><li>Shop</li></ul></div><div class="container"><div class="row">[[<p>A text within containers that only serve the layout of the page.</p><p>It has two paragraphs.</p>]]</div></div><div class="banner cookies">This site has cookies</div><div class="sidebar widget"><p>On the side there is a long text that is of no use to the reader at all.</p></div></body>""",
    """<body><div class="post">[[<h1>Head</h1><p>Part one of it.</p>{{<aside class="related">See also this</aside>}}<p>Part two of it.</p>{{<div class="advertisement">An advert of many words that goes on and on and on and never ends</div>}}<p>Part three of it.</p>{{<form>Your mail <button>Send</button></form>}}<p>Part four.</p>]]</div><div class="responses comment-list" id="discussion"><p>A reader wrote this.</p></div></body>""",
    """<body><div><span>Shop</span> <span>Cart</span></div><p>[[The page begins at once with its first paragraph and has no heading.</p><p>A second one follows.</p><p>Third.]]</p><div><a href="/x">More</a></div></body>""".replace("<p>[[The", "[[<p>The").replace("Third.]]</p>", "Third.</p>]]"),
    """<body><div id="page" class="container wrapper"><div class="row"><div><a href="/">Home</a> <a href="/b">Blog</a></div></div><div class="row">[[<p>The layout has the same names here as round the links above and below.</p><p>So they tell nothing of a text.</p>]]</div><div class="row"><a href="/c">Contact</a> <a href="/d">Data</a></div></div></body>""",
    """<body><div>A long line on what this site is for, and for whom, and since when, and why</div><article>[[<h1>Short</h1><p>A short text.</p>]]</article><div>All that is on this site was made by its makers, and they say so here at some length</div></body>""",
    """<body><div>Welcome to our site with its many pages</div><div class="content">[[<p>Only this is the text.</p>]]</div><p>Another box of words that stands beside it and belongs to something else</p></body>""",
    """[[]]<body><ul><li><a href="/a">One</a></li><li><a href="/b">Two words</a></li></ul><div><a href="/c">Three</a> | <a href="/d">Four more words here</a></div></body>""",
    """<body><div><div>My site</div></div><div>[[<h1>One thing</h1><p>There is a first paragraph of it, of more than a few words.</p><p>There is another.</p>]]</div><div>Copyright 2020 by us</div></body>""",
    """<body><div><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></div><div>[[<h1>Another thing</h1><p>It has one paragraph.</p><ul><li>A point</li><li>One more point</li></ul><p>It ends here.</p>]]</div><div><p>Made by someone in 2021</p></div></body>""",
    """<body><div>Journal</div><div><div>[[<p>What was said of it was said by many, and it was said well.</p><p>So it was.</p>]]</div></div><div><div>All rights are ours</div></div></body>""",
    """<body><article>[[<header><h1>A title in a header</h1></header><p>A first part, with words.</p>{{<nav><a href="#1">Part one</a></nav>}}<p>A second part, with words.</p>{{<footer>Filed under things</footer>}}]]</article></body>""",
    """[[]]<body><nav>Home and away</nav><div class="footer">All rights reserved</div></body>""",
]
# Containers whose name alone tells; each stands once beside or round an article in a labelled page.
BOXES = "ad ads advert advertisement adsbygoogle sponsored sponsor promo banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comments comment replies responses discussion disqus sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc footer header copyright legal disclaimer contentinfo complementary hidden masthead".split()
BODIES = "article content post entry story main articlebody text".split()
LABELLED += [f"""<body><div class="{c}">Some words that are of no use</div><div>[[<p>The text of the page is here, and it is long enough.</p><p>A second paragraph.</p>]]</div></body>""" for c in BOXES]
LABELLED += [f"""<body><{t}>Some words that are of no use</{t}><div>[[<p>The text of the page is here, and it is long enough.</p><p>A second paragraph.</p>]]</div></body>""" for t in sorted(TELLING - {"article", "head", "main"})]
LABELLED += [f"""<body><div><a href="/">Home</a></div><div class="{c}">[[<p>The text of the page is here, and it is long enough.</p><p>A second paragraph.</p>]]</div></body>""" for c in BODIES]

CLASSES = ("content", "plain", "beside", "link")  # of words; all other weights are of tags


def tag_class(name: str) -> str:
    """A tag's name; headings are alike, and so are tags that are no blocks but links and spans."""
    if name in (IN, OUT, "x-not"):
        return ""
    return "<h>" if re.fullmatch("h[1-6]", name) else f"<{name}>" if name in BLOCK or name in ("a", "span") else "<inline>"


def scanned(items: list[Item]) -> list[tuple[str, int]]:
    """What the scan counts of each item: a class of words and their number, a tag, or nothing in boilerplate containers.

    Words are "content" in containers that score as such, "link" in blocks of
    which more than half are links, else "plain", or "beside" on pages that
    have content.
    """
    counts = [len(x.value.split()) if x.kind == "text" and x.score >= 0 else 0 for x in items]
    block = np.cumsum([x.kind == "tag" and x.value in BLOCK for x in items])
    linked = np.bincount(block, weights=[n if x.link else 0 for x, n in zip(items, counts)]) if items else []
    words = np.bincount(block, weights=counts) if items else []
    content = any(n and x.score >= 2 * START for x, n in zip(items, counts))
    out = []
    for x, n, b in zip(items, counts, block):
        if x.score < 0:
            out.append(("", 0))
        elif x.kind == "text":
            out.append(("content" if x.score >= 2 * START else "link" if 2 * linked[b] > words[b] else "beside" if content else "plain", n))
        else:
            out.append((tag_class(x.value), 1))
    return out


class Weights:
    """Weights of containers by feature, and of words by class and tags by name."""

    def __init__(self, container: dict[str, float], part: dict[str, float], other_tag: float):
        self.container, self.part, self.other_tag = container, part, other_tag

    def of(self, what: str) -> float:
        return self.part.get(what, self.other_tag) if what else 0.0


def _marked(page: str) -> str:
    return page.replace("[[", f"<{IN}>").replace("]]", f"<{OUT}>").replace("{{", "<x-not>").replace("}}", "</x-not>")


def container_weights(labelled: list[str], steps: int = 600) -> dict[str, float]:
    """Logistic regression of "words in such containers are of the article", with START for containers that tell nothing."""
    rows = []
    for page in labelled:
        inside, outside = False, 0
        for x in read_page(_marked(page)):
            if x.kind == "tag":
                inside = x.value == IN or inside and x.value != OUT
                outside = outside ^ (x.value == "x-not")
            elif x.features and x.value.strip():
                rows.append((sorted(x.features), inside and not outside))
    index = {f: i for i, f in enumerate(sorted({f for fs, _ in rows for f in fs}))}
    x = np.zeros((len(rows), len(index)))
    for i, (fs, _) in enumerate(rows):
        x[i, [index[f] for f in fs]] = 1
    y = np.array([float(v) for _, v in rows])
    w = np.zeros(len(index))
    for _ in range(steps):
        d = 1 / (1 + np.exp(-(START + x @ w))) - y
        w -= 0.5 * (x.T @ d + 0.02 * w)
    return {f: float(w[i]) if abs(w[i]) >= FAINT else 0.0 for f, i in index.items()}


def train(labelled: list[str], rounds: int = 60, margin: float = 0.5) -> Weights:
    """Containers by logistic regression; words and tags by an averaged perceptron on whole regions.

    The average is over the later half of the rounds. In each the scan's best region, with ``margin`` a word against the
    labelled one, is compared with it, and its counts are taken from the
    weights and those of the labelled region added. Words stay at least 0
    (plain ones above it), tags below.
    """
    container = container_weights(labelled)
    pages = []
    for page in labelled:
        items = read_page(_marked(page), container)
        lo = next(i for i, x in enumerate(items) if x.value == IN)
        hi = next(i for i, x in enumerate(items) if x.value == OUT)
        pages.append((scanned(items), lo + 1, hi))
    names = sorted({k for counts, _, _ in pages for k, _ in counts if k and k not in CLASSES})
    start = dict.fromkeys(CLASSES, 1.0) | dict.fromkeys(names, -1.0)
    low = {"content": 0.1, "plain": 0.1, "beside": 0.0, "link": 0.0}

    def clamped(w):
        return {k: max(v, low[k]) if k in low else min(v, -0.02) for k, v in w.items()}

    now, total, n = dict(start), dict.fromkeys(start, 0.0), 0
    for turn in range(rounds):
        rate = 0.05 / (1 + turn / 10)
        for counts, lo, hi in pages:
            scores = [(now[k] + (0 if k not in CLASSES else -margin if lo <= i < hi else margin)) * c if k else 0.0 for i, (k, c) in enumerate(counts)]
            a, b = best_region(scores)
            if (a, b) != (lo, hi) and not a == b == 0 == hi - lo:
                for i, (k, c) in enumerate(counts):
                    if k:
                        now[k] += rate * c * ((lo <= i < hi) - (a <= i < b))
                now = clamped(now)
            if 2 * turn >= rounds:
                n += 1
                for k, v in now.items():
                    total[k] += v
    part = {k: v / n for k, v in total.items()}
    return Weights(container, part, float(np.median([part[k] for k in names])))


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return train(LABELLED)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch of the largest sum, (0, 0) if none is above zero; earliest, then longest."""
    best, lo, hi, start, total = 0.0, 0, 0, 0, 0.0
    for i, s in enumerate(scores):
        if total <= 0:
            start, total = i, 0.0
        total += s
        if total > best or total == best and lo == start and best > 0:
            best, lo, hi = total, start, i + 1
    return lo, hi


def extract(page: str | None, weights: Weights | None = None) -> str:
    weights = weights or default_weights()
    items = read_page(page or "", weights.container)
    lo, hi = best_region([n * weights.of(what) for what, n in scanned(items)])
    if lo < hi:  # whole blocks
        lo = next((i for i in range(lo, 0, -1) if items[i - 1].kind == "tag" and items[i - 1].value in BLOCK), 0)
        hi = next((i for i in range(hi, len(items)) if items[i].kind == "tag" and items[i].value in BLOCK), len(items))
    blocks, part = [], []
    for x in items[lo:hi]:
        if x.kind == "tag":
            if x.value == "br":
                part.append(" ")
            elif x.value in BLOCK:
                blocks.append("".join(part))
                part = []
        elif x.score >= 0:
            part.append(html.unescape(x.value) if "&" in x.value else x.value)
    blocks.append("".join(part))
    return "\n\n".join(t for b in blocks if (t := " ".join(b.split())))


def main_text(table: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    prepare(table.sparkSession)
    weights = weights or default_weights()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [extract(p, weights) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark, sf_dir):
    return main_text(pages(spark, sf_dir))
