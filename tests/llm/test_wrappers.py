"""Extraction from the supplied pages against a plain version, and from made-up sites of several kinds."""

import json
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from llm.conftest import FOLDER
from voxelframe.llm import dom, wrappers
from voxelframe.llm.queries import QUERIES


def plain_text(html):
    """The article of a supplied page: they all have one article element, and no other markup in it than h1, p, b, br."""
    inner = re.search(r"<article>(.*?)</article>", html, re.DOTALL)[1]
    return " ".join(unescape(re.sub(r"<[^>]+>", " ", inner)).split())


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_registered_query(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op13_html"](spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id]
        assert r.url == page.url and r.text == plain_text(page.html) and r.n_chars == len(r.text)


NAMES = "alder birch cedar dune elm fern grove heath iris jade kelp lark moss nettle oak pine quartz reed sage thorn".split()


def words(rng, n):
    return " ".join(rng.choice(NAMES) + str(rng.randint(0, 99)) for _ in range(n))


def site(kind, n=8, seed=0):
    """(page_id, url, html, wanted text) of a site."""
    rng, out = random.Random(seed), []
    for i in range(n):
        title, paragraphs = words(rng, 4), [words(rng, rng.randint(8, 60)) for _ in range(rng.randint(1, 6))]
        menu = "".join(f'<li><a href="/{k}">{words(rng, 1)}</a></li>' for k in range(5))
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        wanted = " ".join([title, *paragraphs])
        if kind == "classes":  # no article element; everything else is named by its class
            html = (
                f'<div id="header"><a href="/">{words(rng, 2)}</a></div><div class="main-menu"><ul>{menu}</ul></div><div class="cookie-notice">We use cookies {i}</div>'
                f'<div class="post"><h1>{title}</h1>{body}</div><div class="sidebar">{words(rng, 30)}</div><form><input value="x">{words(rng, 4)}</form>'
                f'<div id="comments"><p>{words(rng, 80)}</p></div><div class="siteFooter">{words(rng, 12)}</div>'
            )
        elif kind == "plain":  # no names at all: constant parts and the place of the text have to be found
            html = (
                f"<div>All pages say this in the head of the page</div><div><ul>{menu}</ul></div><div><h1>{title}</h1>{body}</div>"
                "<div>This is what stands at the end of each and every page of the site, for all to see</div>"
            )
        elif kind == "shared":  # an article with a line that all pages share in a place of its own
            html = f'<header>{words(rng, 3)}</header><article><header><h1>{title}</h1></header>{body}<p class="note">Written by the house</p></article><aside>{words(rng, 9)}</aside>'
        elif kind == "comments":  # reader comments as articles of their own, and a teaser
            comments = "".join(f'<article class="comment"><p>{words(rng, 20)}</p></article>' for _ in range(i))
            html = f'<main><article><h1>{title}</h1>{body}<footer>{words(rng, 3)}</footer></article><section class="comments">{comments}</section></main><aside><article>{words(rng, 40)}</article></aside>'
        elif kind == "form":  # the whole page is a form, and the class of the body names a sidebar
            html = f'<body class="has-sidebar"><form id="aspnetForm"><nav>{menu}</nav><div class="with-sidebar"><article><h1>{title}</h1>{body}</article></div></form>'
        else:  # tables
            cells = "".join(f"<tr><td>{p}<td>x" for p in paragraphs)
            html = f"<div id=top><ul>{menu}</ul></div><div id=content><h1>{title}</h1><table>{cells}</table></div>"
            wanted = " ".join([title, *(f"{p} x" for p in paragraphs)])
        out.append((i, f"https://{kind}.example.com/{i}", f"<html><head><title>{title} | Site</title><script>a('</p>')</script></head>{html}", wanted))
    return out


@pytest.mark.parametrize("kind", ["classes", "plain", "shared", "comments", "form", "tables"])
def test_sites(spark, kind):
    rows = site(kind)
    frame = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.extract(frame).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_result_does_not_depend_on_the_partitions(spark):
    rows = [r[:3] for k, kind in enumerate(["classes", "plain", "shared"]) for r in site(kind, 12, k)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [sorted(map(tuple, wrappers.extract(frame.repartition(n), salt=s).collect())) for n, s in ((1, 1), (7, 5))]
    assert texts[0] == texts[1]


ARTICLE = "<title>T</title><article><h1>T</h1><p>{}</p></article>"
EDGES = [
    (1, None, None), (2, "http://a.example/1", ""), (3, "http://a.example/2", "no markup &amp; a < b"), (4, None, ARTICLE.format("x")),
    (5, "not a url", ARTICLE.format("a&nbsp;b\n\tc&lt;p&gt; &#x41;&#65; &copy 1")), (6, "http://a.example/3", "<!-- open " + ARTICLE.format("gone")),
    (7, "http://a.example/4", ARTICLE.format('<a title="unclosed>one</a> two')), (8, "http://a.example/5", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 10),
    (9, "http://a.example/6", ARTICLE.format("x")), (9, "http://a.example/6", ARTICLE.format("x")), (None, "http://a.example/7", ARTICLE.format("n")),
    (10, "http://a.example/8", "<article><p>a<b>b</p><p>c</b><br>d<ul><li>e<li>f</ul><table><tr><td>g<td>h</table><pre> i\n j </pre></article>"),
    (11, "http://a.example/9", ARTICLE.format("long " * 200_000)), (12, "http://a.example/10", "<script>x</script><style>y</style><nav>z</nav>"),
    (13, "http://a.example/11", "<article>" + "".join(f"<div class=c{chr(97 + i % 26)}>w{i}</div>" for i in range(5000)) + "</article>"),
    (14, "http://a.example/12", "<article>" + "<a '" * 20_001 + ">end</article>"),
]
WANTED = {
    1: "", 2: "", 3: "no markup & a < b", 4: "T x", 5: "T a b c<p> AA © 1", 6: "", 8: "deep", 9: "T x", None: "T n", 10: "ab c d e f g h i j",
    11: "T " + " ".join(["long"] * 200_000), 12: "", 13: " ".join(f"w{i}" for i in range(5000)),
}


def test_edges(spark):
    frame = spark.createDataFrame(EDGES, "page_id long, url string, html string").repartition(3)
    extra = {n: F.lit("clash") for n in ("host", "salt", "wrapper", "template", "outside", "node", "layout", "text", "n_chars")}
    rows = wrappers.extract(frame.withColumns(extra)).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r.n_chars == len(r.text)
        if r.page_id in WANTED:
            assert r.text == WANTED[r.page_id], r.page_id
    assert wrappers.extract(frame.where("false")).count() == 0


def test_long_pages_take_linear_time():
    from time import perf_counter

    for part in ("<div class='x'><p>a", "<li>", "</div>", "<b><i>", "<a '", "<!--", "&amp;", "< ", "<script>", "<h2>a</h2><p class=k>b</p>", '<td "'):
        times = []
        for n in (20_000, 80_000):
            start = perf_counter()
            wrappers.article_text(part * n, None, [], [])
            times.append(perf_counter() - start)
        assert times[1] < 10 * times[0] + 0.5, part


def size(slot):
    return 1 + sum(map(size, slot.children))


def plain_match(a, b):
    """Simple tree matching by its recursive definition."""
    if a.label != b.label:
        return 0

    def pairs(x, y):
        if not x or not y:
            return 0
        return max(pairs(x[1:], y), pairs(x, y[1:]), pairs(x[1:], y[1:]) + plain_match(x[0], y[0]))

    return 1 + pairs(a.children, b.children)


def random_tree(rng, depth=0):
    slot = wrappers.Slot("body" if not depth else rng.choice("abc"), 0)
    slot.children = [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3))] if depth < 3 else []
    return slot


@pytest.mark.parametrize("seed", range(20))
def test_matching(seed):
    rng = random.Random(seed)
    a, b = random_tree(rng), random_tree(rng)
    wrappers.nodes_of(a), wrappers.nodes_of(b)
    assert wrappers.Matching().match(a, b)[0] == plain_match(a, b)
    slots = wrappers.align(a, b, size(b))
    assert sum(s >= 0 for s in slots) == plain_match(a, b) and len({s for s in slots if s >= 0}) == plain_match(a, b)
    both = wrappers.merged(iter([json.dumps(wrappers.nodes_of(a)), json.dumps(wrappers.nodes_of(b))]))
    assert len(json.loads(both)) == size(a) + size(b) - plain_match(a, b)


def test_named_parts():
    assert dom.judge("div", ' class="mainMenu"')[1] == "named" and dom.judge("div", " id=ad-300")[1] == "named"
    assert dom.judge("div", ' class="header_text shadow address"')[1] == "" and dom.judge("section", " role='Navigation'")[1] == "out"
    assert dom.judge("div", ' class="a1 b c"')[0] == "div.b.c"


def test_wrapper_keeps_every_slot():
    """Layouts with together more different children than any bound: each aligns with the wrapper to its last node."""
    layouts = [json.dumps([(0, "body"), *[(1, f"div.{k}-{i}") for i in range(150)]]) for k in range(5)]
    wrapper = wrappers.merged(iter(layouts))
    assert len(json.loads(wrapper)) == 751
    for text in layouts:
        nodes = json.loads(text)
        slots = wrappers.align(wrappers.tree_of(json.loads(wrapper)), wrappers.tree_of(nodes), len(nodes))
        assert min(slots) == 0 and len(set(slots)) == 151
