"""Main text: the page reader, the choice of nodes, and accuracy on pages and layouts that the trees haven't seen."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from terrapath.llm import main_text
from terrapath.llm.dom import KINDS, Page
from terrapath.llm.layouts import MARK, Layout

SCHEMA = "page_id long, url string, html string, text string, n_chars string, features string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(*x, *["clash"] * 4) for x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def trees(spark):
    return main_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def article_of(page):
    """The text of the one article element, by its known form."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = [re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b) for b in re.split(r"</?(?:p|h1)>", inner)]
    return " ".join(x for b in blocks if (x := " ".join(html.unescape(b).split())))


def test_every_page_is_its_article(spark, trees):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in main_text.extract(frame(spark, rows), trees).collect()}
    assert got == {r["page_id"]: (r["url"], article_of(r["html"]), len(article_of(r["html"]))) for r in rows}


def test_layouts_that_were_not_trained_on(spark, trees):
    words = " ".join(Page(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").first()["html"]).texts.values()).split()
    hit = missed = false = 0
    for seed in range(5_000, 5_300):
        page = Page(Layout(words, seed).page())
        main = {i for i, t in page.texts.items() if t.startswith(MARK)}
        for i in main:
            page.chars[i] -= 1
        forest = main_text.Forest([page])
        kept = forest.choose(trees.log_odds(forest.features()))
        got = {i for i in page.texts if kept[i]}
        hit, false, missed = hit + sum(page.chars[i] for i in got & main), false + sum(page.chars[i] for i in got - main), missed + sum(page.chars[i] for i in main - got)
    assert hit / (hit + false) > 0.98 and hit / (hit + missed) > 0.98


def test_ordinary_pages(trees):
    blog = """<body><div id="cookie-banner">We use cookies. <button>Accept</button></div><header class="site-header"><a href="/">My Blog</a><nav><ul><li><a href="/a">Home</a></ul></nav></header>
      <div class="content"><h1>How to bake&nbsp;bread</h1><p>Bread is baked from flour, water &amp; salt.<p>Short one.</p><ul><li>Mix the <b>fl</b>our with
      water.<li>Knead.</ul><div class="ad">Buy now! Cheap ovens.</div><p>Then bake it<br>for forty minutes.</p></div><div class="sidebar"><h3>Recent</h3><ul><li><a href="x">Cakes</a></ul></div>
      <section id="comments"><h3>1 comment</h3><div class="comment"><p>Great post, thanks for sharing this with all of us! I baked it yesterday.</p></div><form><label>Name</label><input></form></section><footer>&copy; 2020</footer>"""
    assert main_text.texts([blog], trees.log_odds) == ["How to bake bread Bread is baked from flour, water & salt. Short one. Mix the flour with water. Knead. Then bake it for forty minutes."]


def test_messy_rows(spark, trees):
    long = "<article><h1>T</h1>" + "".join(f"<p>Sentence {k} of a long page, with words.</p>" for k in range(20_000)) + "</article><footer>&copy; x</footer>"
    deep = "<article><p>Once there was a text in the middle of it all.</p>" + "<div>" * 5_000 + "</div>" * 5_000
    pages = [None, "", " \n", "<p>", "just words, no markup at all", "<nav><ul><li><a href=/>Home</a></ul></nav>", long, long, deep, "<script>var a = '<p>no</p>'", "<article><p>Text that is <", "<!-- <p>gone</p>"]
    rows = [(k if k % 3 else None, None if k % 4 else "u", p) for k, p in enumerate(pages)]
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_text.extract(frame(spark, rows), trees).collect()), key=str)
    texts = main_text.texts([p for _, _, p in rows], trees.log_odds)
    assert got == sorted(((i, u, t, len(t)) for (i, u, _), t in zip(rows, texts, strict=True)), key=str)
    assert texts[:4] == [""] * 4 and texts[5] == texts[9] == texts[11] == "" and texts[6] == texts[7]
    assert texts[6] == "T " + " ".join(f"Sentence {k} of a long page, with words." for k in range(20_000))
    assert texts[8] == "Once there was a text in the middle of it all."


def test_no_pages_and_no_words(spark):
    assert main_text.extract(frame(spark, [])).collect() == []
    assert [r["text"] for r in main_text.extract(frame(spark, [(1, "u", None), (2, None, "<p> </p>")])).collect()] == ["", ""]


def test_the_page_reader():
    def read(page):
        p = Page(page)
        return [(KINDS[p.kind[p.parent[i]]], t) for i, t in p.texts.items()]

    assert read("<p>a<p>b<div>c</div>d") == [("p", "a"), ("p", "b"), ("div", "c"), ("other", "d")]
    assert read("<ul><li>a<ul><li>b</ul>c<li>d</ul>") == [("item", "a"), ("item", "b"), ("item", "c"), ("item", "d")]
    assert read("<table><tr><td>a<td>b<tr><th>c</table>d") == [("cell", "a"), ("cell", "b"), ("cell", "c"), ("other", "d")]
    assert read("a<b>b</b> <i>c</i>&lt;p&gt;&amp &notin; &#x41;") == [("other", "ab c<p>& ∉ A")]
    assert read('<div title="a > b">x</div><div title=\'">\'>y</div>') == [("div", "x"), ("div", "y")]
    assert read("<STYLE>p{}</Style><title>t</title>x<!-- c --><![CDATA[y]]>z<?pi?>") == [("other", "xz")]
    assert read("a < b </p> c <3") == [("other", "a < b"), ("other", "c <3")]
    assert read("") == read("<>" * 0) == [] and read("<div>" * 1_000 + "x")[0][1] == "x"


@pytest.mark.parametrize("bad", ['<a "' * 50_000, "<" * 100_000, "<b>" * 50_000 + "<p>" * 50_000, "<!--" * 50_000, "<p '>" * 50_001, "<li>a" * 50_000, "<td>" * 50_000, "</p>" * 50_000, "<svg>" * 50_000])
def test_hostile_pages_take_time_in_proportion(bad):
    began = time.process_time()
    Page(bad)
    assert time.process_time() - began < 20


def test_the_choice_is_the_best_consistent_one():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(2, 9)
        p = Page("")
        for k in range(1, n):
            p.parent.append(r.randrange(max(0, k - 2), k))
        p.depth = [0] * n
        for k in range(1, n):
            p.depth[k] = p.depth[p.parent[k]] + 1
        p.kind = p.hint = p.chars = p.links = p.words = p.marks = p.end = [0] * n
        scores = np.array([r.choice([-3.5, -1.25, 0.5, 2.75, -0.125]) for _ in range(n)])
        kept = main_text.Forest([p]).choose(scores)
        assert all(kept[p.parent[k]] for k in range(1, n) if kept[k])
        best = max(sum(scores[k] for k in c) for m in range(n) for c in itertools.combinations(range(1, n), m) if all(p.parent[k] in (0, *c) for k in c))
        assert scores[1:][kept[1:]].sum() == best
