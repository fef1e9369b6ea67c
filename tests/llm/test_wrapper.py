"""HTML extraction: what is left out, what stays, what a host's template is, and tree matching against brute force."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from threadline.llm import wrapper as W

PAGE = "page_id bigint, url string, html string"


def _texts(spark, pages: list) -> dict:
    return {r["page_id"]: r["text"] for r in W.extract(spark.createDataFrame(pages, PAGE)).collect()}


def test_one_page_without_its_frame(spark):
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) x="</p>";</script>
    <body class="has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><div id="sidebarLeft"><p>Popular</div>
    <main><article class="post related-none"><header><h1>The &amp; title&hellip;</h1></header>
    <p>First  <b>bold</b> word<br>next&nbsp;line<p>a &lt; b &#39;q&#39; <!-- no --><div class="ad">Buy</div>
    <ul><li>one<li>two</ul><table><tr><td>c1<td>c2<tr><td>c3</table><blockquote>quote</blockquote>
    <form><input value=v><label>Mail</label><button>Go</button></form>
    <div class="share-buttons">Share</div><footer>By me</footer>
    <section class="comments"><article class="comment"><p>Nice!</p></article></section></article></main>
    <aside>More</aside><footer>&copy; me</footer></body></html>"""
    want = "The & title… First bold word next line a < b 'q' one two c1 c2 c3 quote"
    assert _texts(spark, [(1, "http://a.example/x", html)]) == {1: want}


def test_damaged_and_odd_pages(spark):
    deep = "<div>" * 3_000 + "deep" + "</div>" * 3_000
    long = "<article>" + "<p>some words" * 40_000 + "</article>"
    pages = [
        (1, None, None), (2, "not an address", ""), (3, "http://a.example", "no markup at all"), (4, "http://a.example/", deep),
        (5, "http://a.example/5", long), (6, "http://a.example/6", "<article><p>cut <b>off <a href='x"), (7, None, "<p>a</b></i><p>b</article>"),
        (8, "http://a.example/8", "<head><title>t</title><h1>no body</h1><p>text"), (9, "http://a.example/9", "<script>never closed <p>x"),
        (10, "http://a.example/10", "<form id=aspnet><h1>whole</h1><p>page in a form</p></form>"),
        (11, "http://a.example/11", "<article>&#x1F600; &bogus; &amp;lt; &#0;</article>"),
    ]
    got = _texts(spark, [*pages, pages[2]])
    assert got[5] == " ".join(["some words"] * 40_000)
    assert (got[1], got[2], got[3], got[4], got[7], got[8], got[9], got[10]) == ("", "", "no markup at all", "deep", "a b", "no body text", "", "whole page in a form")
    assert got[6].startswith("cut off") and got[11] == "\U0001f600 &bogus; &lt; �"
    odd = spark.createDataFrame([(1, "http://a.example", "<p>x", "t", "h", 1)], PAGE + ", text string, host string, constant int")
    out = W.extract(odd)
    assert out.columns == ["page_id", "url", "host", "constant", "text"] and out.first()["text"] == "x"
    assert W.extract(odd.limit(0)).count() == 0


def _page(k: int, body: str) -> str:
    return f"<html><body><div class=top>The Daily Example, since 1901</div><div class=body><h2>Headline {k}</h2>{body}</div><div class=legal>All rights kept by the Daily Example</div></body></html>"


def test_constant_nodes_become_template(spark):
    bodies = [f"<p>Story {k} begins.</p>" + f"<p>It goes on {k}.</p>" * (k % 4) for k in range(12)]
    pages = [(k, f"https://daily.example/{k}", _page(k, b)) for k, b in enumerate(bodies)]
    # Another structure on the same host, and one of its kind that differs in a template slot.
    pages.append((50, "https://daily.example/50", _page(50, "<div class=teaser>An inset</div><p>Long read.</p>")))
    pages.append((51, "https://daily.example/51", _page(51, "<p>Special.</p>").replace("since 1901", "special issue")))
    # A host with too few pages keeps all.
    pages.append((60, "https://other.example/60", _page(60, "<p>Alone.</p>")))
    got = _texts(spark, pages)
    for k in range(12):
        assert got[k] == " ".join([f"Headline {k}", f"Story {k} begins.", *[f"It goes on {k}."] * (k % 4)])
    assert got[50] == "Headline 50 An inset Long read."
    assert got[51] == "The Daily Example, special issue Headline 51 Special."
    assert got[60] == "The Daily Example, since 1901 Headline 60 Alone. All rights kept by the Daily Example"
    wrapper = {r["host"]: r["constant"] for r in W.wrappers(spark.createDataFrame(pages, PAGE)).collect()}
    assert len(wrapper["daily.example"]) == 2 and wrapper["other.example"] == []


def test_copies_of_an_article_stay(spark):
    """A third of a host's pages hold one article, the others have it nearly; none of it is template."""
    same = "<article><h1>Copied</h1><p>Every word of it.</p><div class=box>Inset of the host</div></article>"
    pages = [(k, f"http://copy.example/{k}", f"<body><nav>n{k}</nav>{same}<footer>{k}</footer>") for k in range(30)]
    near = "<article><h1>Copied</h1><p>Every word of it.</p><p>And {k}.</p><div class=box>Inset of the host</div></article>"
    pages += [(k, f"http://copy.example/{k}", near.replace("{k}", str(k))) for k in range(30, 60)]
    got = _texts(spark, pages)
    # The inset is on pages with different main texts, so it is template; heading and paragraphs are not.
    assert {got[k] for k in range(30)} == {"Copied Every word of it."}
    assert all(got[k] == f"Copied Every word of it. And {k}." for k in range(30, 60))
    whole = [(k, f"http://only.example/{k}", same) for k in range(10)]
    assert set(_texts(spark, whole).values()) == {"Copied Every word of it. Inset of the host"}


def _tree(rng: random.Random, depth: int) -> list:
    return [rng.choice("ab"), "", 1, [_tree(rng, depth - 1) for _ in range(rng.randint(0, 3 if depth else 0))]]


def _most(x: list, y: list) -> int:
    """Nodes of the largest matching, trying every way to pair up the children in order."""
    if x[0] != y[0]:
        return 0
    best = 0
    for k in range(min(len(x[3]), len(y[3])) + 1):
        for left in itertools.combinations(x[3], k):
            for right in itertools.combinations(y[3], k):
                sizes = [_most(a, b) for a, b in zip(left, right, strict=True)]
                best = max(best, sum(sizes))
    return 1 + best


def test_tree_matching_is_largest():
    rng = random.Random(2)
    for _ in range(150):
        x, y = _tree(rng, 2), _tree(rng, 2)
        pairs = W.align(x, y)
        assert len(pairs) == _most(x, y)
        left, right = W.preorder(x), W.preorder(y)
        assert all(left[a][0] == right[b][0] for a, b in pairs)
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        order = sorted(pairs)
        assert [b for _, b in order] == sorted(b for _, b in pairs)


def test_hosts(spark):
    urls = ["HTTP://User@Host.Example:80/x", "https://a.b/?q", "x", None, "http://h#f"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in rows.select(W.host(F.col("url"))).collect()] == ["host.example", "a.b", "", "", "h"]
