import html
import re
import time

from tidewright.llm import html_text
from tidewright.llm.common import pages


def brute(page):
    """The tables' pages keep their main text in <article>."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|li|blockquote|div|section|table|tr|td|pre)\b[^>]*>", inner)
    blocks = [" ".join(html.unescape(re.sub(r"<br\s*/?>", " ", re.sub(r"</?(?:b|i|em|a|span|strong)\b[^>]*>", "", x))).split()) for x in parts]
    return "\n\n".join(b for b in blocks if b)


def test_matches_the_articles(spark):
    for r in html_text.op8_html_text(spark, "/root/testdata/sf0.01").join(pages(spark, "/root/testdata/sf0.01").select("page_id", "html"), "page_id").collect():
        assert r["text"] == brute(r["html"]), r["page_id"]
        assert r["n_chars"] == len(r["text"])


def test_labelled_pages_come_back():
    for page in html_text.LABELLED:
        inside = re.sub(r"\{\{.*?\}\}", "", re.search(r"\[\[(.*)\]\]", page, re.S)[1])
        got = html_text.extract(re.sub(r"\[\[|\]\]|\{\{|\}\}", "", page))
        assert got == html_text.extract(f"<article>{inside}</article>"), page
        assert bool(got) == bool(inside)


# Layouts and names that no labelled page has, with their text.
HELD_OUT = [
    ("<body><div><p>This is a long article about something.</p><p>Second paragraph of real text.</p></div></body>", "This is a long article about something.\n\nSecond paragraph of real text."),
    ("just a page of plain words", "just a page of plain words"),
    ('<div class="foo"><div class="qux"><p>Hello there my friend, how are you?</p><p>Well.</p></div></div>', "Hello there my friend, how are you?\n\nWell."),
    ('<article><p>text <span class="ad sponsored">buy now</span> goes on <math><mi>x</mi></math> and <svg><text>y</text></svg> here</p></article>', "text goes on x and y here"),
    ("<div><a href=1>Home</a> <a href=2>News</a></div>", ""),
    ("<p>Read on and on, it says. See <a href=1>this page</a></p>", "Read on and on, it says. See this page"),
    ('<div class="wrap"><div class="hd"><a href=/>Site</a></div><div class="bd"><h1>A headline of news</h1><p>Some first paragraph goes here with words.</p><div class="adsbygoogle">click me</div><p>And a last.</p></div><div class="ft">Copyright 2020</div></div>', "A headline of news\n\nSome first paragraph goes here with words.\n\nAnd a last."),
    ("<body><div><ul><li><a>Home</a></li><li><a>About</a></li></ul></div><div><h3>Title of it</h3><p>First real paragraph with words in it.</p><ul><li>item one</li><li>item two</li></ul><p>End.</p></div><div><p>Made in 2024</p></div></body>", "Title of it\n\nFirst real paragraph with words in it.\n\nitem one\n\nitem two\n\nEnd."),
    ('<body><main><section class="hero"><h1>Big words</h1></section><p>A text of its own.</p><video controls>no video here</video></main><section id="user-comments"><p>I read it all, and it was very good to read, every word.</p></section></body>', "Big words\n\nA text of its own.\n\nno video here"),
    ('<div id="cookie-bar">We have cookies</div><article><p>one &amp; two</p><nav><a href="#a">part a</a></nav><p>three</p><footer>filed under things</footer></article>', "one & two\n\nthree"),
    ("<table><tr><td><a href=1>x</a></td><td><p>A cell that holds a whole text, as they did in the old days.</p><p>It goes on.</p></td></tr></table>", "A cell that holds a whole text, as they did in the old days.\n\nIt goes on."),
    ('<div class="content"><p>Kept.</p><noscript>also kept</noscript><button>Press</button><select><option>none</option></select><object>shown instead</object></div>', "Kept.\n\nalso kept\n\nshown instead"),
]


def test_held_out_layouts():
    assert [(page, got) for page, want in HELD_OUT if (got := html_text.extract(page)) != want] == []


def test_words_score_positive_and_tags_negative():
    w = html_text.default_weights()
    assert w.part["content"] > 0 and w.part["plain"] > 0 and all(v < 0 for k, v in w.part.items() if k.startswith("<")) and w.other_tag < 0


def test_held_out_layout():
    page = """<!DOCTYPE html><body class=home><header class="site-header"><p>My site has a long name and slogan</p></header><nav><a href=1>x</a></nav>
    <div class="cookie-banner">We store cookies, please do agree to it now</div><article><h1>A&amp;B</h1><p>x
     y <a href="/l">link</a> z<p>second &lt;b&gt;<div class="ad">buy me now please</div><p>tail</p></article>
    <section class="comments"><p>first! what a great article this is, really</p></section><form>Your name and your address here</form><footer>all the rights we have are reserved for ever</footer></body>"""
    assert html_text.extract(page) == "A&B\n\nx y link z\n\nsecond <b>\n\ntail"


def test_odd_pages(spark):
    odd = [None, "", "   ", "plain words", "<p>one", "<", "<<<>>>", "<!-- never closed <p>a", "<script>var a='</p>'", "a<b", "<p title='>'>q</p>", "<p a='", "&nbsp;&copy;", "<article>\U0001f600 é</article>"]
    rows = spark.createDataFrame([(i, None if i % 2 else "u", h, "clash") for i, h in enumerate(odd)] + [(1, "u", "x y", "c"), (None, "u", None, "c")], "page_id long, url string, html string, text string")
    out = html_text.main_text(rows).collect()
    assert len(out) == len(odd) + 2
    got = {r["page_id"]: r["text"] for r in out if r["page_id"] not in (1, None)}
    assert got[0] == "" and got[4] == "one" and got[10] == "q" and got[13] == "\U0001f600 é"
    assert html_text.main_text(rows.limit(0)).count() == 0
    t = time.time()
    for big in ("<div>" * 50_000, "<p>a" * 50_000, "<!--" * 100_000, "<a '" * 50_000, "</" * 100_000, "&amp" * 100_000):
        html_text.extract(big)
    assert time.time() - t < 30


def test_best_region_is_the_maximum():
    import random

    rng = random.Random(5)
    for _ in range(300):
        s = [rng.randrange(-4, 4) for _ in range(rng.randrange(0, 14))]
        lo, hi = html_text.best_region(s)
        assert sum(s[lo:hi]) == max([0, *(sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1))])
