"""Main text of pages: known pages, and branches that entropy alone can tell."""

import time
import math

import pytest

from isomesh.llm import sitestyle
from isomesh.llm.sitestyle import Page
from tests.llm.helpers import SMALL

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>Title &amp; more</h1></header><p><b>One <i>two</i>\n  three.<br><p>Four&nbsp;five&copy; &lt;b&gt;</p><ul><li>x<li>y</ul>
<div class="comments"><article><p>reader says</p></article></div><aside>side</aside><form><p>f</p></form>tail</article><div id="sidebar">S</div><footer>&copy; f</footer>"""


def test_marks():
    assert Page(PAGE).text(set()) == "Title & more\nOne two three.\nFour five© <b>\nx\ny\ntail"
    assert Page("plain &lt;b&gt; text <p>a<p>b").text(set()) == "plain <b> text\na\nb"
    assert Page("<div><p>x</p> mid <span class='ad'>ad</span> end</div><table><tr><td>1<td>2</table>").text(set()) == "x\nmid end\n1\n2"
    assert [Page(s).text(set()) for s in ("", " ", "<", "<p", "<!-- x", "<script>a", "<p>é𝒳 &am", "a < b")] == ["", "", "<", "", "", "", "é𝒳 &am", "a < b"]
    assert Page("<p>" * 5000 + "deep").text(set()) == "deep"
    assert Page("<div>" * 3000 + "deep").text(set()) == "deep"


def site(spark):
    rows = []
    for i in range(40):
        words = " ".join(f"w{i * 7 + k * k}" for k in range(30))
        rows.append((i, f"http://Site.example.org/{i}", f"<body><div class='top'><b>Welcome</b> to us</div><div class='story'><p>{words}</p><p>{words[::-1]}</p></div><div class='end'>Made by us</div></body>", "x"))
    rows += [(100, "http://lone.example.org/1", "<div class='top'>Only page</div>", None), (101, None, None, None), (102, "bad url", "", ""), (102, "bad url", "", "")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")


def test_entropy_cuts_what_is_alike_on_a_host(spark):
    got = {r.page_id: r for r in sitestyle.report(site(spark)).collect()}
    for r in site(spark).where("page_id < 40").collect():
        story = r.html.split("<p>")[1:3]
        assert got[r.page_id].text == "\n".join(s.split("</p>")[0] for s in story)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert got[100].text == "Only page"
    assert [(got[i].text, got[i].n_chars) for i in (101, 102)] == [("", 0)] * 2
    assert sitestyle.report(site(spark)).count() == 44


def test_importance_equals_brute_force(spark):
    pages = site(spark).collect()
    seen = {}
    for r in pages:
        page = Page(r.html or "")
        free = {n for b in page.blocks if not b.cut and not b.inside for n in b.path}
        host = (r.url or "").split("/")[2].lower() if "://" in (r.url or "") else ""
        for kind, of in (("p", page.presentations()), ("c", page.contents())):
            for n, f in of.items():
                if n in free:
                    seen.setdefault((host, n), {}).setdefault(kind, []).append(f)
    low = set()
    for key, kinds in seen.items():
        entropy = []
        for values in kinds.values():
            m = len(values)
            shares = [values.count(v) / m for v in set(values)]
            entropy.append(-sum(p * math.log(p, m) for p in shares) if m > 1 else 1.0)
        if max(map(len, kinds.values())) >= sitestyle.MIN_PAGES and max(entropy) < sitestyle.LEAST_IMPORTANT:
            low.add(key)
    got = {(r.host, r.node) for r in sitestyle.unimportant(sitestyle.pages_of(site(spark))).collect()}
    assert got == low and low


def test_importance_decides_inside_and_outside_of_articles(spark):
    rows = []
    for i in range(20):
        words, teaser = " ".join(f"w{i * 7 + k * k}" for k in range(40)), f"Teaser {i}"
        rows.append((i, f"http://a.example.org/{i}", f"<body><article><h1>T{i}</h1><p>{words}</p><div class='box'>Get our letter</div></article></body>"))
        rows.append((100 + i, f"http://b.example.org/{i}", f"<body><article>{teaser}</article><div class='story'>{words}</div><div class='end'>Made by us</div></body>"))
    got = {r.page_id: r.text for r in sitestyle.report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(20):
        words = " ".join(f"w{i * 7 + k * k}" for k in range(40))
        assert got[i] == f"T{i}\n{words}" and got[100 + i] == f"Teaser {i}\n{words}"


def test_copies_keep_their_text_and_that_of_other_pages(spark):
    story = lambda i: " ".join(f"w{i * 7 + k * k}" for k in range(40))
    page = lambda text, note="": f"<body>{note}<div class='story'><p>{text}</p></div><div class='end'>Made by us</div></body>"
    rows = [(i, "http://copies.example.org/", page("One story")) for i in range(8)]
    rows += [(100 + i, "http://mixed.example.org/", page(story(0))) for i in range(400)] + [(1000 + i, "http://mixed.example.org/", page(story(i))) for i in range(1, 11)]
    rows += [(2000 + i, "http://near.example.org/", page(story(0), f"<!-- {i} -->")) for i in range(300)] + [(3000 + i, "http://near.example.org/", page(story(i))) for i in range(1, 6)]
    got = {r.page_id: r.text for r in sitestyle.report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i].startswith("One story") for i in range(8))
    assert all(got[100 + i] == story(0) for i in range(400)) and all(got[1000 + i] == story(i) for i in range(1, 11))
    assert all(got[2000 + i] == story(0) for i in range(300)) and all(got[3000 + i] == story(i) for i in range(1, 6))


def test_driver_pages_and_empty_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in sitestyle.report(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text and "<p>" not in r.text and "track(" not in r.text
        article = r.html.split("<article>")[1].split("</article>")[0]
        assert r.n_chars <= len(article)
    assert sitestyle.report(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article style="overflow: hidden"><p>Body one</p></article>', "Body one"),
        ('<article data-id="nav"><p>x</p></article>', "x"),
        ('<div class="content has-sidebar"><p>a</p></div>', "a"),
        ('<div class="article-form">b</div>', "b"),
        ('<article class="overflow-hidden">c</article>', "c"),
        ('<article><h1 class="post-header">Title</h1><p>d</p></article>', "Title\nd"),
        ("<p data-x=it's>Hello world don't stop</p><p>tail</p>", "Hello world don't stop\ntail"),
        ("<p>a<br>b</p>", "a b"),
        ('<div class="site-footer">f</div><p>1 < 2 &amp; 3</p>', "1 < 2 & 3"),
        ('<div id=cookieBanner>x</div>y<div style="display: none">z</div>', "y"),
        ('<p>open</p><a href="no end>lost</a>', "open"),
    ],
)
def test_attributes_are_read_as_written(html, text):
    assert sitestyle.Page(html).text(set()) == text


def test_reading_takes_linear_time():
    for page in ("<a " * 300000 + '"', '<a b="' * 150000, "<p>" * 100000, "<div>x" * 20000, "<" * 300000):
        began = time.time()
        sitestyle.Page(page[: 1 << 20])
        assert time.time() - began < 5
