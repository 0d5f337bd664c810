"""Operator 6: the parser on hand-made pages, the host suffix array against brute force, and time against size."""

import random
import time
from collections import defaultdict

import pytest

from loomlake.llm import html_text


@pytest.mark.parametrize(
    "page,text",
    [
        ('<html><head><title>t</title><script>var t="</p>"; if (a<b) {}</script></head><nav>menu</nav><article><h1>A &amp; B</h1><p>x<b>y</b><p class="ad">buy</p><div class="comments">c</div>z &lt;</article><footer>f</footer>', "A & B xy z <"),
        ("<article>cut off &am", "cut off &am"),
        ("<article>a<p>b<p>c<br>d<ul><li>e<li>f</ul>g</article>", "a b c d e f g"),
        ('<main>x<aside>n</aside><div hidden>h</div><div role="navigation">r</div><form>q</form>y</main>', "x y"),
        ('<article>one<a title="a > b">two</a> three</article>', "onetwo three"),
        ("<article>one <p title=\"never closed>two</article>", "one two"),
        ("<article>a < b and <5 c<!-- x > y --> d<!doctype z></article>", "a < b and <5 c d"),
        ("<article>kept</article> outside", "kept"),
        ("<article>a</article>b<article>c</article>", "a c"),
        ("<article><p>a</div></section></p>b</article>", "a b"),
        ('<article><div class="cookie notice">no</div><p class="alert-free">yes</p></article>', None),
        ("<article>x<script>never closed</article>", "x"),
        ("<article>x<style/>y</article>", "xy"),
        ("<ARTICLE>A\n\t B&nbsp;C<NAV>n</NAV></ARTICLE>", "A B C"),
        ("<article>tail <a href='x", "tail"),
        ("", ""),
        ("<form action=x><input><article>text<form>q</form></article><button>b</button></form>", "text"),
        ("<main>a<form>q</form>b</main><form>never closed", "a b"),
        ("<article>&am<b>p;</b> &lt<!-- -->; &#6<i>5;</i></article>", "&amp; <; 5;"),
    ],
)
def test_parser(page, text):
    inner, outer, marked = html_text.parse(page)
    if text is None:
        assert inner == [("yes", True)]
    else:
        assert " ".join(t for t, _ in (inner if marked else outer)) == text


@pytest.mark.parametrize("part", ['<a "', "<a '\"", '<a href="', "<div>", "</div>", "<script>", "<!--", "<", "<p>x", "&am", '<i class="a b c', "<b =", "</p><div>", "<form>", "<form><main>"])
def test_time_is_linear(part):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_text.parse("<article>" + part * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.02)


def test_names_inside_the_main_part(spark):
    """Names that an article may use are in doubt there, and only repetition on the host takes their text away."""
    share = "tell all of your friends about this page right now"
    page = lambda n: f"<main><section id='social'>Social science essay {n}</section><p>t{n}</p><div class='share'>{share}</div><section class='skip'>over it {n}</section></main>"
    rows = [(1, "http://h/1", page("one")), (2, "http://h/2", page("two")), (3, "http://alone/3", page("three"))]
    rows += [(4, "http://h/4", "<article>x<div id='header'>A header of its own</div><div class='ad'>buy</div></article>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Social science essay one tone over it one", 2: "Social science essay two ttwo over it two", 3: f"Social science essay three tthree {share} over it three", 4: "x A header of its own"}


def test_pages_of_a_host(spark):
    foot = "all rights reserved by the site owner since long ago"
    rows = [(3, "http://h/3", f"<div>unique one</div><div>{foot}</div>"), (4, "http://h/4", f"<p>another text</p><div>{foot}</div>"), (5, "http://other/5", f"<div>{foot}</div>"), (6, None, "<article>own</article>"), (7, "http://h/7", None), (None, "http://h/8", "plain"), (4, "http://h/4", f"<p>another text</p><div>{foot}</div>")]
    related = "<article><p>Long text</p><div class='related-work'>what was done before on the matter at hand here</div><div class='widget-box'>subscribe to our letter now and get the news daily</div></article>"
    rows += [(10, "http://h/10", related), (11, "http://h/11", related.replace("Long text", "Other words").replace("what was done", "nothing was done at all"))]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, text string, h int")
    got = html_text.main_text(docs).collect()
    want = [(3, "unique one"), (4, "another text"), (4, "another text"), (5, foot), (6, "own"), (7, ""), (None, "plain")]
    want += [(10, "Long text what was done"), (11, "Other words nothing was done at all")]
    assert sorted(((r.page_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(docs.limit(0)).count() == 0


def test_unique_runs_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    menus = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 7, 8, 9, 20)]
    pages = []
    for i in range(60):
        host = "abc"[i % 3]
        blocks = [rng.choice(menus), " ".join(f"p{i}_{k}" for k in range(rng.randrange(0, 12))), rng.choice(menus), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 15)))]
        pages.append((i, f"http://{host}/{i}", "".join(f"<div>{b}</div>" for b in blocks)))
    pages += [(100, "http://a/c", pages[0][2]), (101, "http://long/1", "<div>" + " ".join(f"t{k}" for k in range(20000)) + "</div>")]
    tokens = {p: " ".join(t for t, _ in html_text.parse(h)[1]).split() for p, _, h in pages}
    host = {p: u.split("/")[2] for p, u, _ in pages}
    where = defaultdict(set)
    for p, w in tokens.items():
        for i in range(len(w) - html_text.LONG + 1):
            where[host[p], tuple(w[i : i + html_text.LONG])].add(p)
    want = {}
    for p, w in tokens.items():
        gone = {j for i in range(len(w) - html_text.LONG + 1) if len(where[host[p], tuple(w[i : i + html_text.LONG])]) > 1 for j in range(i, i + html_text.LONG)}
        want[p] = " ".join(t for j, t in enumerate(w) if j not in gone) or " ".join(w)
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want
