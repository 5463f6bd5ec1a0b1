"""Main text of web pages."""

import html
import itertools
import re
import time

import numpy as np
import pytest

import __spark_entry__ as E
from caderneta.llm import dom, page_text

SF = "/root/testdata/sf0.001"


def test_held_out_generated_pages():
    right = wrong = 0
    for page in (dom.Page(p, labelled=True) for p in page_text.labelled_pages(120, 12345)):
        opened = page_text.open_nodes(page.parent, page_text.fit().logits(dom.features(page)))
        for element, text, _ in page.runs:
            label = page.label[element] if page.label[element] is not None else page.label[page.parent[element]]
            right, wrong = (right + len(text), wrong) if opened[element] == label else (right, wrong + len(text))
    assert wrong < 0.02 * (right + wrong)


def test_decoding_is_the_best_without_contradiction():
    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(1, 10))
        parent = [-1, *(int(r.integers(0, i)) for i in range(1, n))]
        logits = r.normal(size=n) * 3
        yes, no = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
        legal = [o for o in itertools.product([False, True], repeat=n) if all(p < 0 or o[p] or not o[i] for i, p in enumerate(parent))]
        best = max(legal, key=lambda o: sum(yes[i] if o[i] else no[i] for i in range(n)))
        assert page_text.open_nodes(parent, logits) == list(best)


def test_query_on_the_table(spark):
    """The articles of these pages are marked; a plain reading of the mark gives the expected text."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        inner = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        want[r["page_id"]] = (r["url"], " ".join(html.unescape(inner).split()))
    got = E.queries()["op5_page_text"](spark, SF).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class=page>
<div id="cookie-notice"><p>We use cookies to improve your visit.</p><button>OK</button></div>
<header class="site-header"><div class=logo>The Paper</div><form action=s><label>Find</label><input><button>Go</button></form></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>World</a><li><a href=/c>Sport</a></ul></nav>
<div class="wrapper"><div class="article-body"><h1>A   title &amp; more</h1><p>First<b>bold</b> para&shy;graph with <a href=x>a link</a>,<br>and a&nbsp;break.
<div class="ad-box">Buy now, this is a very good offer.</div><p>Second paragraph &lt;tag&gt; has several words in it, too.<p>Short.
<table><tr><td>One<td>Two<tr><td>Three</table><script>var x = "<p>not this</p>";</script><!-- nor <p>this</p> --></div>
<aside class=sidebar><h3>Popular</h3><ul><li><a href=1>One thing</a></li><li><a href=2>Other thing</a></li></ul></aside></div>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this story very much, thank you for it.</p></div></section>
<footer>&copy; 2020 The Paper. All rights reserved.</footer></body></html>"""


def test_a_page_with_everything():
    assert page_text.main_text(PAGE) == (
        "A title & more Firstbold para\xadgraph with a link, and a break. Second paragraph <tag> has several words in it, too. Short. One Two Three"
    )


@pytest.mark.parametrize("text", ["", "   ", "<", "<p", "<>", "</p></div>", "<p a='>", "&amp;&#x41;&bogus;", "<script>x", "<iframe>x<p>y</p>", "<div>" * 3000 + "deep", "<b>" * 9 + "x"])
def test_broken_pages(text):
    page = dom.Page(text)
    assert len(dom.features(page)) == len(page.tag)
    assert isinstance(page_text.main_text(text), str)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, PAGE, "x"), (1, None, PAGE, "x"), (None, "u", None, "y"), (3, "v", "", None)], "page_id long, url string, html string, text string")
    got = page_text.extract(df).collect()
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0] and len(got) == 4
    assert page_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("close", ["</script>", "</SCRIPT >"])
def test_letters_that_grow_in_lower_case_move_no_offset(close):
    page = dom.Page(f"<body><p>{'\u0130' * 50}</p><script>var a = '<p>no</p>';{close}<p>first words</p><div>more <b>words</b></div><p>last</p></body>")
    assert [x for _, x, _ in page.runs] == ["\u0130" * 50, "first words", "more words", "last"]


def test_formulas_stay_in_their_line():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x = {2}</annotation></semantics></math>"
    page = dom.Page(f"<body><p>where {formula} holds</p></body>")
    assert [x for _, x, _ in page.runs] == ["where x=2 holds"]


@pytest.mark.parametrize("html", [
    "<div data-y=><p data-y>text</p></div>", '<a "x' * 7_500, "<a 'x>" * 20_000, "<p>a</p>" * 100_000, "<div>" * 50_000 + "x" + "</div>" * 50_000,
    "<title>" * 40_000, "<textarea x" * 40_000, "<!--" + "<p>" * 50_000, "</b></div>" * 50_000, "<li><div>" * 2_000 + "<td>" * 20_000, "<" * 200_000,
])
def test_hostile_pages_take_linear_time(html):
    began = time.process_time()
    page = dom.Page(html)
    dom.features(page)
    assert time.process_time() - began < 12


def test_unclosed_sections_and_text_behind_the_last_tag():
    texts = lambda html: [t for _, t, _ in dom.Page(html).runs]
    assert texts("<p>a</p>b <!-- c <p>d</p> e") == ["a", "b"]
    assert texts("<p>a</p>b 1 < 2") == ["a", "b 1 < 2"]
    assert texts("<p>a</p>b <!-- c") == ["a", "b"]
    assert texts("<div data-y=0><p data-y=0>a</p></div>") == ["a"]
    assert all(x is None for x in dom.Page("<div data-y=1>a</div>").label)
    assert dom.Page("<div data-y=1>a</div>", labelled=True).label[1] is True
