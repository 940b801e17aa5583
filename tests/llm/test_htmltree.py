"""HTML extraction: parsing of broken pages, exact marginals, and the texts of known pages."""

import html
import itertools
import math
import random
import re

import pytest
from dualcast.llm import htmltree, queries
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return htmltree.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_articles_of_the_table(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op5_main_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_another_dress(model):
    prose = "A sentence that is long enough to be a part of an article, as they go."
    page = f"""<body><div id="hd"><h1>Site</h1></div><ul class="menu"><li><a href=x>Home</a><li><a>About us</a></ul>
      <div class=cookie-banner><p>We use cookies. {prose}</p></div><div class="post-content"><h2>Title &amp; more</h2><p>{prose}<br>next
      <p>Second <b>one {prose}<ul><li>{prose}</ul></div><div id="comments"><div class="comment"><p>I liked it. {prose}</p></div></div>
      <aside><p>{prose}</p></aside><form><label>Name</label><button>Send</button></form><div class="footer">Copyright</div>"""
    assert htmltree.main_text(page, model) == f"Title & more\n{prose} next\nSecond one {prose}\n{prose}"


def test_marginals_by_enumeration(model):
    rng = random.Random(6)
    names = ["<div>", "<p>some words here.", "</div>", '<div class="ad">', "<article>", "text", "<ul><li>x", "</article>", "<a href=#>go on</a>"]
    for _ in range(60):
        tree = htmltree.parse("".join(rng.choice(names) for _ in range(8)))
        if len(tree.tag) > 10:
            continue
        total, content = 0.0, [0.0] * len(tree.tag)
        for states in itertools.product((0, 1), repeat=len(tree.tag)):
            z = model.root[states[0]]
            for i, s in enumerate(states):
                z += sum(model.nodes[f][s] for f in htmltree.features(tree, i) if f in model.nodes)
                if i:
                    z += model.edge[htmltree.edge_kind(tree, i)][states[tree.parent[i]]][s]
            total += math.exp(z)
            for i, s in enumerate(states):
                content[i] += s * math.exp(z)
        assert htmltree.marginals(tree, model) == pytest.approx([c / total for c in content], abs=1e-6)


@pytest.mark.parametrize("page, pieces", [
    ("", []), ("<", [("#page", "<")]), ("a<b>c</b> d", [("#page", "ac d")]), ("<p>x<p>y", [("p", "x"), ("p", "y")]),
    ("<script>var a='<p>no</p>'</script><p>1 &lt; 2 &amp;amp;", [("p", "1 < 2 &amp;")]),
    ("<div>a<div>b</div>c</div>", [("div", "a"), ("div", "b"), ("div", "c")]),
    ("<!-- <p>no --><p title='>'>yes</P >", [("p", "yes")]), ("</p></div><p>a<!-- open", [("p", "a")]),
    ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]),
    ("<p>one\n  two<br/>three four", [("p", "one two three four")]), ("<table><tr><td>a<td>b<tr><td>c", [("td", "a"), ("td", "b"), ("td", "c")]),
])
def test_parse(page, pieces):
    tree = htmltree.parse(page)
    assert [(tree.tag[b], t) for b, t in tree.pieces] == pieces


def test_odd_rows(spark, model):
    pages = ["<div>" * 20_000 + "x", "<p>" * 20_000, "<a <b \" ' >" * 2000, "</p></div>" * 3000, None, "", "<p>é"]
    df = spark.createDataFrame([(None if i == 4 else i, None, p) for i, p in enumerate(pages)] * 2, "page_id long, url string, html string")
    df = df.withColumns({c: F.lit(1) for c in ("text", "n_chars", "name")})
    found = htmltree.extract(df, model).collect()
    assert len(found) == 14 and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in found)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    own = htmltree.fit(empty)
    assert htmltree.extract(empty, own).count() == 0
    assert htmltree.main_text("<nav>menu</nav><article><p>A text of some words, with a stop.</p></article>", own) == "A text of some words, with a stop."


PAGE = "<article><p>A text of some words, with a stop.</p></article>"


@pytest.mark.parametrize("before", [
    "<html><head><title>x</title><body>", "<html><head><meta charset=utf-8><title>x</title><style>p {}</style>",
    "<head><title>x</title></head><body><svg/>", '<body><svg width="1" href="/a/b" /><math/>', "<svg><path/></svg><math><mi>x</mi></math>",
])
def test_optional_ends(model, before):
    """A head without an end and a closed svg or math swallow nothing; their own content stays out."""
    assert htmltree.main_text(before + PAGE, model) == "A text of some words, with a stop."
