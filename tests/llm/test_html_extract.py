from __future__ import annotations

import random
import re
import time
from html import unescape

import pytest

from larkspur.llm.html_extract import Page, main_texts
from tests.conftest import DATA

PAGES = "page_id long, url string, html string"


def text(html: str) -> str:
    return Page(html).text()


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""), ("plain  words", "plain words"), ("<p>a &amp; b<p>c&nbsp;d<br>e", "a & b\n\nc d e"), ("<title>t</title><p>x", "x"),
        ("<p>a<!-- no --><b>b</b><i>c</i></p>", "abc"), ("<script>var t='</p>';</script><style>p{}</style><p>x", "x"), ("<p>x</p><script>never closed", "x"),
        ("<nav>m</nav><header>h</header><p>x</p><aside>s</aside><form>f</form><footer>g</footer>", "x"),
        ('<div class="ad">q</div><div id="cookie-banner">q</div><div class="siteHeader">q</div><p class="lead">x</p>', "x"),
        ("<body><div>intro</div><article><h1>T</h1><p>x</p></article><p>after</p>", "T\n\nx"), ("<main><p>x</p></main><p>y</p>", "x"),
        ("<article><p>x</p><article>a comment</article><section class='comments'><p>c</p></section></article>", "x"),
        ('<form action="."><article><header><h1>T</h1>by me</header><p>x</p></article><footer>f</footer></form>', "T\n\nx"),
        ("<nav><ul><li>never closed<article><p>x</p></article>", "x"), ("<article><p>x</div></section><p>y</article>z", "x\n\ny"),
        ('<a title="1 > 0">q</a> 2 < 3', "q 2 < 3"), ('<p title="open>x</p>', "x"), ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\n1 2\n\n3"),
        ("<p hidden>q</p><p style='display: none'>q</p><p aria-hidden='true'>q</p><p>x", "x"), ("<p>x</p><pre>a\n  b</pre>&#65;&bogus;", "x\n\na b\n\nA&bogus;"),
        ("<div><a>1</a><a>2</a><a>3</a></div><p>x <a>y</a></p>", "x y"), ("<p>x</p", "x"), ("<p>x<!-- open", "x"), ("<nav>only</nav>", ""),
    ],
)
def test_main_text_of_a_page(html, want):
    assert text(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><h2 id='related-work'>R</h2><section id='social-impact'><p>s</p></section><p class='search-results'>x</p></article>", "R\n\ns\n\nx"),
        ("<article><p>x</p><div class='related'>q</div><section class='comments'>q</section></article>", "x"),
        ("<div role='navigation'>q</div><p role='note'>x</p><div class='badge'>y</div>", "x\n\ny"),
    ],
)
def test_class_words_leave_prose_alone(html, want):
    assert text(html) == want


def articles(pages) -> dict:
    """A plain cut at the article's tags, which the driver's pages all have."""
    want = {}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    return want


def test_driver_pages_equal_their_articles(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    got = main_texts(pages).collect()
    assert {r.page_id: r.text for r in got} == articles(pages) and all(r.n_chars == len(r.text) for r in got)


def test_driver_pages_by_templates_alone(spark):
    """Without HTML's landmarks, articles or class names, counting finds the frames of all 2,500 pages."""
    path = DATA / "sf0.1" / "pages.parquet"
    if not path.exists():
        pytest.skip("the driver's tables aren't here")
    pages = spark.read.parquet(str(path))
    want = articles(pages)
    got = {r.page_id: r.text for r in main_texts(pages, by_markup=False, by_class=False).collect()}
    assert sum(got[i] == want[i] for i in want) > 0.99 * len(want)
    framed = {r.page_id: r.text for r in main_texts(pages, by_markup=False, by_class=False, host_pages=10**9, domain_pages=10**9).collect()}
    assert all(len(framed[i]) > len(want[i]) for i in want)  # the counting, and nothing else, removed them


CITIES = "Rome Bonn Lyon Graz Bath Kiel Nice Cork".split()


def test_templates_are_deleted_and_copies_of_an_article_are_not(spark):
    """Subtrees that recur on a host go, by content alone; an article on many pages of a host stays."""
    frame = "<div><div>Our shop in {c} is open</div><section><p>{t}</p><p>{t} again</p></section></div>"
    rows = [(i, f"http://a.org/{i}", frame.format(c="Rome", t=f"page {i}")) for i in range(8)]
    rows += [(10 + i, f"http://b.org/{i}", frame.format(c=CITIES[i], t=f"page {i}")) for i in range(8)]
    rows += [(20 + i, f"http://a.org/x{i}", "<div>Our shop in Rome is open</div><article><div>The same</div><p>story</p></article>") for i in range(30)]
    rows += [(60 + i, f"http://c{i}.d.org/", f"<div>Call 0{i}1 or ask c{i}.d.org now</div><p>text {i}</p><p>{CITIES[i]}</p>") for i in range(8)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"page {i}\n\npage {i} again" for i in range(8))
    assert all(got[10 + i] == f"Our shop in {CITIES[i]} is open\n\npage {i}\n\npage {i} again" for i in range(8))
    assert all(got[20 + i] == "The same\n\nstory" for i in range(30))
    assert all(got[60 + i] == f"text {i}\n\n{CITIES[i]}" for i in range(8))  # by domain, host and numbers masked


def test_text_stays_when_the_host_grows(spark):
    def pages(n: int):
        return spark.createDataFrame([(i, "http://a.org/", f"<div>our menu</div><p>long text number {i} here</p><p>and {i}</p><div>{'rare' if i < 3 else f'own {i} x'}</div>") for i in range(n)], PAGES)

    few, many = ({r.page_id: r.text for r in main_texts(pages(n)).collect()} for n in (6, 2000))
    assert all(few[i] == many[i] for i in range(6)) and "rare" not in many[0] and "our menu" not in many[5]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_templates_equal_a_plain_count(spark):
    """Pages without landmarks, made of nested div elements that are known by construction: no parser, and pages told apart by what is outside an element."""
    from larkspur.llm.html_extract import DOMAIN_PAGES, HOST_PAGES

    rng = random.Random(5)
    frames = {h: [(words(rng, rng.choice([3, 200])),) for _ in range(4)] for h in range(9)}  # of one text each, short or far longer than a story
    pages, rows = [], []
    for i in range(120):
        h = rng.randrange(9)
        parts = [x for x in frames[h] if rng.random() < 0.8] + [(words(rng, 12), words(rng, 4))]
        if rng.random() < 0.3 and pages:
            parts = rng.choice([p for k, p in pages if k == h] or [parts])  # the same page once more
        rng.shuffle(parts := list(parts))
        pages.append((h, parts))
        html = "".join("<div>" + "".join(f"<div>{t}</div>" if len(p) > 1 else t for t in p) + "</div>" for p in parts)
        rows.append((i, f"http://w{h}.site{h % 4}.org/{i}", f"<body>{html}</body>"))
    outside: dict = {}
    for h, parts in pages:
        for p in parts:
            for element in {p, *((t,) for t in p)}:  # an element, and those in it
                rest = sorted(t for q in parts for t in q if not (q == p and (element == p or t == element[0])))
                for site in (("host", h), ("domain", h % 4)):
                    outside.setdefault((site, element), set()).add(tuple(rest))
    template = lambda h, e: len(outside[("host", h), e]) >= HOST_PAGES or len(outside[("domain", h % 4), e]) >= DOMAIN_PAGES
    want = {i: "\n\n".join(t for p in parts if not template(h, p) for t in p if not template(h, (t,))) for i, (h, parts) in enumerate(pages)}
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want and sum(len(t) for p in frames.values() for (t,) in p) > 0 and any(len(want[i]) < len(rows[i][2]) / 3 for i in want)


def test_long_frames_around_short_stories_go(spark):
    rng = random.Random(6)
    notice, legal = words(rng, 300), words(rng, 400)
    rows = [(i, "http://a.org/", f"<div>{notice}</div><p>{words(rng, 9)}</p><div><div>{legal}</div></div>") for i in range(12)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(notice not in t and legal not in t and len(t.split()) == 9 for t in got.values())


def test_an_article_repeated_in_one_frame_stays(spark):
    rows = [(i, "http://a.org/", f"<div>our menu of the day</div><div>the same story, told in full</div><div>seen {i} times by all</div>") for i in range(12)]
    got = {r.text for r in main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == 12 and all("the same story" in t and "our menu" in t for t in got)


def test_time_is_linear_in_nesting():
    def took(n):
        began = time.perf_counter()
        page = Page("<nav>x" * n)
        assert page.text() == "" and page.text(set(page.digests()), False) == ""
        return time.perf_counter() - began

    took(500)
    assert took(24_000) < 10 * took(6_000) + 0.2


def test_many_templates_join_without_broadcast(spark, monkeypatch):
    from larkspur.llm import html_extract as h

    monkeypatch.setattr(h, "MOST_SENT", 0)
    rows = [(i, "http://a.org/", f"<div>menu</div><p>{i}</p>") for i in range(9)]
    assert sorted(r.text for r in main_texts(spark.createDataFrame(rows, PAGES)).collect()) == sorted(map(str, range(9)))


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "no host", ""), (2, None, "<p>x"), (2, None, "<p>x"), (3, "http://h/", "<div>" * 5000 + "deep" + "</p>" * 5000)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'clash' as text", "1 as host", "2 as id", "3 as salt", "4 as templates")
    got = main_texts(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1), (3, "deep", 4)]
    assert main_texts(pages.limit(0)).count() == 0
