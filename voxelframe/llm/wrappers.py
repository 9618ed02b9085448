"""HTML extraction by wrapper induction: the pages of a host are aligned, what stays the same is template.

A page's tree is reduced to its layout: repeated neighbours become one node, runs of plain paragraphs, lists and tables
one prose node. Pages of one layout align with themselves, so the layouts of a host are aligned instead of its pages, by
simple tree matching: the largest order-keeping matching of two trees with equal labels. Matched nodes become one slot of
the host's wrapper, others are added to it. Layouts are merged in buckets, then the buckets' wrappers, so no task holds
a host's pages. A wrapper keeps every slot of its layouts; in a layout, nodes beyond WIDTH and DEPTH count to their parent.

A slot whose text is the same on all pages of a host, over at least three different articles, is template. Varying slots
are content, as far as they belong to the article: menus, adverts and footers vary as well, and are known by their names
(`dom.parts_of`). Where pages name no article, the slot that holds most of the host's varying text outside links is its
place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm import dom
from voxelframe.llm.common import small_batches
from voxelframe.session import cut_lineage

DEPTH = 40
#: Children of a node of a layout; a node with more counts as prose with all it contains.
WIDTH = 200
#: Different articles over which a text has to stay the same.
ARTICLES = 3
#: Share of a slot's text that has to stand in one of its children for that child to be the article's place.
SHARE = 0.6
LINKS = 0.6
BUCKETS = 16
PROSE = frozenset(
    "p h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure figcaption address details summary li dt dd tr td th tbody thead tfoot caption center".split()
)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; nothing where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _hash(*texts: str) -> int:
    import xxhash

    state = xxhash.xxh64(seed=42)
    for text in texts:
        state.update(text.encode("utf-8", "replace"))
        state.update(b"\0")
    return int(np.uint64(state.intdigest()).view(np.int64))


def layout_of(page: dom.Page, out: list[bool]) -> tuple[list[tuple[int, str]], list[int]]:
    """The layout as (depth, label) in page order, and the layout node of every node of the page.

    Nodes outside the article by name are leaves. Neighbours with equal layouts are one node.
    """
    size = len(page.tags)
    depth, children = [0] * size, [[] for _ in range(size)]
    for i in range(1, size):
        up = page.parents[i]
        depth[i] = depth[up] + 1
        children[up].append(i)
    shapes: list[tuple] = [()] * size
    numbers: dict[tuple, int] = {}
    shown: list[list[list[int]]] = [[] for _ in range(size)]  # per node: its different children in a row, each a list of equals
    for i in range(size - 1, -1, -1):
        label = page.labels[i]
        plain = label == page.tags[i]
        name = label + "!" if out[i] else "prose" if plain and page.tags[i] in PROSE else label
        groups: list[list[int]] = []
        if name != "prose" and not out[i] and depth[i] < DEPTH:
            for c in children[i]:
                if groups and shapes[groups[-1][0]] == shapes[c]:
                    groups[-1].append(c)
                else:
                    groups.append([c])
            if len(groups) > WIDTH:
                groups = []
        shown[i] = groups
        shape = (name, tuple(numbers.setdefault(shapes[g[0]], len(numbers)) for g in groups))
        shapes[i] = shape
    layout: list[tuple[int, str]] = []
    place = [0] * size
    stack: list[tuple[list[int], int]] = [([0], 0)]
    while stack:
        equals, d = stack.pop()
        at = len(layout)
        layout.append((d, shapes[equals[0]][0]))
        for node in equals:
            place[node] = at
        # Equal nodes have equal children group by group.
        merged = [[c for node in equals for c in shown[node][k]] for k in range(len(shown[equals[0]]))]
        for group in reversed(merged):
            stack.append((group, d + 1))
        if not merged:
            for node in equals:
                below = list(children[node])
                while below:
                    c = below.pop()
                    place[c] = at
                    below += children[c]
    return layout, place


class Slot:
    """A node of a layout or wrapper."""

    __slots__ = ("label", "children", "index")

    def __init__(self, label: str, index: int):
        self.label, self.children, self.index = label, [], index


def tree_of(nodes: list) -> Slot:
    stack: list[Slot] = []
    for index, (depth, label) in enumerate(nodes):
        slot = Slot(label, index)
        del stack[depth:]
        if stack:
            stack[-1].children.append(slot)
        stack.append(slot)
    return stack[0]


def nodes_of(slot: Slot) -> list[tuple[int, str]]:
    out, stack = [], [(slot, 0)]
    while stack:
        s, depth = stack.pop()
        s.index = len(out)
        out.append((depth, s.label))
        stack += [(c, depth + 1) for c in reversed(s.children)]
    return out


class Matching:
    """Simple tree matching of two trees: sizes of the largest matchings, and the matched children behind them."""

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[int, list]] = {}

    def match(self, a: Slot, b: Slot) -> tuple[int, list[tuple[int, int]]]:
        """(matched nodes, pairs of matched children by place) of two nodes with equal labels. Depth is bounded by DEPTH."""
        key = (id(a), id(b))
        if key not in self.known:
            x, y = a.children, b.children
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i, p in enumerate(x, 1):
                row, above = best[i], best[i - 1]
                for j, q in enumerate(y, 1):
                    value = above[j] if above[j] >= row[j - 1] else row[j - 1]
                    if p.label == q.label:
                        both = above[j - 1] + self.match(p, q)[0]
                        if both > value:
                            value = both
                    row[j] = value
            pairs, i, j = [], len(x), len(y)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
            self.known[key] = (1 + best[-1][-1], pairs[::-1])
        return self.known[key]


def merge(wrapper: Slot, tree: Slot) -> None:
    """Add a tree to a wrapper: matched nodes become one, others are put in between. Both have a body as their root."""
    matching, stack = Matching(), [(wrapper, tree)]
    while stack:
        a, b = stack.pop()
        pairs = matching.match(a, b)[1]
        children, at = [], 0
        taken = dict((j, i) for i, j in pairs)
        for j, child in enumerate(b.children):
            if j in taken:
                i = taken[j]
                children += a.children[at : i + 1]
                at = i + 1
                stack.append((a.children[i], child))
            else:
                children.append(child)
        children += a.children[at:]
        a.children = children


def align(wrapper: Slot, tree: Slot, size: int) -> list[int]:
    """The slot of every node of a layout, -1 where it matches none."""
    out = [-1] * size
    matching, stack = Matching(), [(wrapper, tree)]
    while stack:
        a, b = stack.pop()
        out[b.index] = a.index
        stack += [(a.children[i], b.children[j]) for i, j in matching.match(a, b)[1]]
    return out


def merged(layouts: Iterator[str]) -> str:
    """The wrapper of layouts or wrappers, in the given order."""
    wrapper = None
    for text in layouts:
        tree = tree_of(json.loads(text))
        if wrapper is None:
            wrapper = tree
        else:
            merge(wrapper, tree)
    return json.dumps(nodes_of(wrapper), ensure_ascii=False, separators=(",", ":"))


def _measure(html: str) -> tuple[dom.Page, list[bool], list[bool] | None, str, list[int]]:
    page = dom.read(html)
    out, inside = dom.parts_of(page)
    layout, place = layout_of(page, out)
    return page, out, inside, json.dumps(layout, ensure_ascii=False, separators=(",", ":")), place


MEASURED = "layout long, node int, host string, shape string, text_hash long, article int, free boolean, chars long, links long"


def _measured(pages: DataFrame) -> DataFrame:
    """One row per layout node with text of every page; row 0 of a page has its host and layout."""

    def work(batches):
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page, out, inside, shape, place = _measure(html.as_py() or "")
                layout = _hash(host, shape)
                texts: dict[int, list] = {}
                core = []
                for node, text, links in page.blocks:
                    if out[node] or inside is not None and not inside[node]:
                        continue
                    core.append(text)
                    found = texts.setdefault(place[node], [[], 0, 0])
                    found[0].append(text)
                    found[1] += len(text)
                    found[2] += min(links, len(text))
                article = _hash(*core) % 64
                rows.append((layout, -1, host, shape, None, article, inside is None, 0, 0))
                rows += [(layout, k, None, None, _hash(*t), article, inside is None, n, m) for k, (t, n, m) in texts.items()]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MEASURED.split(", ")])

    return pages.select("host", "html").mapInArrow(work, MEASURED)


def _wrapper_of(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [merged(iter(sorted(rows["shape"])))]})


def _slots_of(layouts: pd.DataFrame, wrapper: pd.DataFrame) -> pd.DataFrame:
    """The slot of every layout node, for some layouts of a host."""
    rows = []
    if len(wrapper):
        whole = tree_of(json.loads(wrapper["wrapper"].iloc[0]))
        for host, layout, shape in zip(layouts["host"], layouts["layout"], layouts["shape"], strict=True):
            nodes = json.loads(shape)
            rows += [(host, layout, node, slot) for node, slot in enumerate(align(whole, tree_of(nodes), len(nodes)))]
    return pd.DataFrame(rows, columns=["host", "layout", "node", "slot"])


def _place(nodes: list, weight: dict[int, int]) -> int:
    """The slot that holds the article: from the body down, while one child has most of the weight of its parent."""
    parents, path = [], []
    for index, (depth, _) in enumerate(nodes):
        del path[depth:]
        parents.append(path[-1] if path else -1)
        path.append(index)
    total = [weight.get(i, 0) for i in range(len(nodes))]
    for i in range(len(nodes) - 1, 0, -1):
        total[parents[i]] += total[i]
    at = 0
    while True:
        below = [i for i in range(len(nodes)) if parents[i] == at and nodes[i][1] != "prose"]
        best = max(below, key=lambda i: (total[i], -i), default=None)
        if best is None or not total[best] or total[best] < SHARE * total[at]:
            return at
        at = best


def _rules_of(slots: pd.DataFrame, wrapper: pd.DataFrame) -> pd.DataFrame:
    """The host's wrapper with the slots that are template, and those outside the article's place where pages name none."""
    if not len(wrapper) or not len(slots):
        return pd.DataFrame({"host": [], "wrapper": [], "template": [], "outside": []})
    nodes = json.loads(wrapper["wrapper"].iloc[0])
    template = sorted(int(s) for s, t in zip(slots["slot"], slots["template"], strict=True) if t and s >= 0)
    outside: list[int] = []
    if slots["free"].any():
        varying = slots[~slots["slot"].isin([*template, -1])]
        linked = {int(s) for s, n, m in zip(varying["slot"], varying["chars"], varying["links"], strict=True) if m > LINKS * n}
        weight = {int(s): int(n - m) for s, n, m in zip(varying["slot"], varying["chars"], varying["links"], strict=True) if int(s) not in linked}
        at = _place(nodes, weight)
        end = next((i for i in range(at + 1, len(nodes)) if nodes[i][0] <= nodes[at][0]), len(nodes))
        outside = [i for i in range(len(nodes)) if not at <= i < end or i in linked]
    return pd.DataFrame({"host": [wrapper["host"].iloc[0]], "wrapper": [wrapper["wrapper"].iloc[0]], "template": [template], "outside": [outside]})


def induce(pages: DataFrame) -> DataFrame:
    """The wrappers (host, wrapper, template, outside) of pages (host, html); hosts whose pages need none are left out.

    ``wrapper`` is a list of (depth, label) as JSON, the others are places in it.
    """
    small_batches(pages.sparkSession)
    measured = cut_lineage(_measured(pages))
    layouts = measured.where("node = -1").groupBy("layout").agg(F.first("host").alias("host"), F.first("shape").alias("shape"))
    layouts = cut_lineage(layouts.withColumn("bucket", F.pmod("layout", F.lit(BUCKETS)).cast("int")))
    part = layouts.select("host", "bucket", "shape").groupBy("host", "bucket").applyInPandas(_wrapper_of, "host string, wrapper string")
    wrappers = part.withColumnRenamed("wrapper", "shape").groupBy("host").applyInPandas(_wrapper_of, "host string, wrapper string")
    wrappers = cut_lineage(wrappers)

    dealt = wrappers.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    slots = layouts.groupBy("host", "bucket").cogroup(dealt.groupBy("host", "bucket")).applyInPandas(_slots_of, "host string, layout long, node int, slot int")
    counted = measured.where("node >= 0").groupBy("layout", "node").agg(
        F.min("text_hash").alias("low"), F.max("text_hash").alias("high"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("article"))).alias("articles"), F.bool_or("free").alias("free"),
        F.sum(F.when(F.col("free"), F.col("chars")).otherwise(0)).alias("chars"), F.sum(F.when(F.col("free"), F.col("links")).otherwise(0)).alias("links"),
    )
    found = counted.join(slots, ["layout", "node"]).groupBy("host", "slot").agg(
        ((F.min("low") == F.max("high")) & (F.bit_count(F.bit_or("articles")) >= ARTICLES)).alias("template"),
        F.bool_or("free").alias("free"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
    )
    rules = found.groupBy("host").cogroup(wrappers.groupBy("host")).applyInPandas(_rules_of, "host string, wrapper string, template array<int>, outside array<int>")
    return cut_lineage(rules.where((F.size("template") > 0) | (F.size("outside") > 0)))


@lru_cache(maxsize=4096)
def _wrapper_tree(wrapper: str) -> Slot:
    return tree_of(json.loads(wrapper))


@lru_cache(maxsize=1 << 14)
def _aligned(wrapper: str, shape: str) -> list[int]:
    nodes = json.loads(shape)
    return align(_wrapper_tree(wrapper), tree_of(nodes), len(nodes))


def article_text(html: str, wrapper: str | None, template: list[int], outside: list[int]) -> str:
    """The blocks of the article, joined by spaces. A heading that the page's title repeats is never template. If the host's
    place of the article has no text on a page that names no article, all its parts that are not surroundings count."""
    page, out, inside, shape, place = _measure(html)
    slots = _aligned(wrapper, shape) if wrapper else []
    fixed, apart = set(template), set(outside)

    def kept(everywhere: bool) -> list[str]:
        texts = []
        for node, text, _ in page.blocks:
            if out[node] or inside is not None and not inside[node]:
                continue
            slot = slots[place[node]] if slots else -1
            if slot in fixed and not (page.tags[node] in dom.HEADINGS and page.title and (page.title.startswith(text) or text.startswith(page.title))):
                continue
            if inside is None and slot in apart and not everywhere:
                continue
            texts.append(text)
        return texts

    return " ".join(kept(False) or kept(True))


def extract(pages: DataFrame, salt: int = 16) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    ``text`` is the main text: character references decoded, white space within a block one space, blocks in page order
    joined by one space. A null or empty html gives an empty text; pages without a host are a host of their own; repeated
    rows are returned again; an empty table gives no rows; other columns are not read. Pages meet their host's wrapper in a
    join whose smaller side is one row per host, dealt out ``salt`` times so that a host's pages spread over tasks.
    """
    read = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    rules = induce(read).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    salted = read.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(salt)))
    joined = salted.join(rules, ["host", "salt"], "left")
    kind = next(f.dataType.simpleString() for f in read.schema.fields if f.name == "page_id")

    def work(batches):
        for batch in batches:
            texts = []
            for html, wrapper, template, outside in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                texts.append(article_text(html.as_py() or "", wrapper.as_py(), template.as_py() or [], outside.as_py() or []))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", "wrapper", "template", "outside").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
