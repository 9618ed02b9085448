"""Reading HTML: a tree of block elements, the text blocks in page order, and what parts of the page are by name.

Only elements that make blocks, or that are named as something other than the article, become nodes; other elements
leave their text to the node around them. End tags that browsers imply are implied. The time is linear in the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


BLOCKS = _words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul"
)
#: Elements whose content is no markup; the text of a title is kept apart, that of the others is not read.
RAW = _words("script style title textarea xmp iframe noembed noframes noscript template")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
#: Elements that are never part of an article.
OUT_TAGS = _words(
    "nav footer aside button select optgroup option datalist fieldset legend label menu dialog svg object canvas audio video map applet search"
)
ROLES = {
    **dict.fromkeys(("navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form"), "out"),
    "main": "main", "article": "article",
}
#: Words of class names and ids of what surrounds an article.
OUT_WORDS = _words(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos promoted "
    "banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer footers "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices popup popups modal overlay alert alerts newsletter subscribe signup "
    "signin login share sharing social comment comments commentlist disqus respond reply replies related recommended recommendations "
    "pagination pager paging search searchbox searchform form skip copyright colophon"
)
HEAD_NAMES = _words("header head site-header global-header top-header")
CLOSES_P = BLOCKS - _words("td th tr tbody thead tfoot caption option optgroup legend body")
LISTS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
LISTS |= dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody thead tfoot", "table"))
LISTS = {tag: (_words(a), _words(b) | _words("body")) for tag, (a, b) in LISTS.items()}
CELLS = _words("td th caption table")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--|<[!?/][^>]*+>""")
#: The same where a quote of the page never closes: a tag then ends at its first >.
BARE_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<!--|<[!?/][^>]*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAMED = re.compile(r"class|id\s*=|role|itemprop", re.IGNORECASE)
NAME = re.compile(r"[a-z]+", re.IGNORECASE)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=1 << 16)
def judge(tag: str, attributes: str) -> tuple[str, str]:
    """(label, kind) of an element: kind is ``out``, ``named`` (out by its class or id), ``head``, ``form``, ``main``,
    ``article`` or nothing. The label is the tag with its class and id; parts with digits are left out, as they vary."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    parts = (found.get("class", "") + " " + found.get("id", "")).split()
    label = ".".join([tag, *sorted({p for p in parts if not any(c.isdigit() for c in p)})])
    words = {w.lower() for p in parts for w in NAME.findall(CAMEL.sub("-", p))}
    kind = "out" if tag in OUT_TAGS else "form" if tag == "form" else ROLES.get(found.get("role", "").strip().lower(), "")
    if not kind and words & OUT_WORDS:
        kind = "named"
    if not kind and (tag == "header" or HEAD_NAMES & {p.lower() for p in parts} and tag not in HEADINGS):
        kind = "head"
    if not kind and (tag in ("main", "article") or found.get("itemprop") == "articleBody"):
        kind = "article" if tag == "article" else "main"
    return label, kind


@dataclass
class Page:
    """Nodes in page order (node 0 is the body), and blocks: (node, text, characters within links)."""

    title: str = ""
    tags: list[str] = field(default_factory=lambda: ["body"])
    labels: list[str] = field(default_factory=lambda: ["body"])
    kinds: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def squeeze(text: str) -> str:
    """White space turned into single spaces, none at the ends."""
    return " ".join(text.split())


class _Reader:
    def __init__(self, html: str):
        self.page = Page()
        self.stack = [0]
        self.open: dict[str, int] = {"body": 1}
        self.parts: list[str] = []
        self.links = 0
        self.in_link = False
        self.read(html)

    def flush(self) -> None:
        if self.parts:
            text = squeeze("".join(self.parts))
            if text:
                self.page.blocks.append((self.stack[-1], text, self.links))
            self.parts, self.links = [], 0

    def text(self, raw: str) -> None:
        if raw:
            found = unescape(raw) if "&" in raw else raw
            self.parts.append(found)
            if self.in_link:
                self.links += len(found)

    def pop(self, tags: frozenset[str], until: frozenset[str] = frozenset()) -> None:
        """Close elements up to the nearest of ``tags``, if it stands above the nearest of ``until``."""
        names = self.page.tags
        for at in range(len(self.stack) - 1, 0, -1):
            name = names[self.stack[at]]
            if name in tags:
                for node in self.stack[at:]:
                    self.open[names[node]] -= 1
                del self.stack[at:]
                return
            if name in until:
                return

    def start(self, tag: str, attributes: str) -> None:
        page = self.page
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "a":
            self.in_link = True
        block = tag in BLOCKS
        label, kind = judge(tag, attributes) if block or tag in OUT_TAGS or NAMED.search(attributes) else (tag, "")
        if tag in ("body", "html", "head") or tag in VOID and not block or not block and kind not in ("out", "named", "main", "article"):
            return
        self.flush()
        if tag in CLOSES_P and self.open.get("p"):
            self.pop(frozenset(["p"]), CELLS)
        if tag in LISTS and any(self.open.get(t) for t in LISTS[tag][0]):
            self.pop(*LISTS[tag])
        if tag in VOID:
            return
        page.tags.append(tag)
        page.labels.append(label)
        page.kinds.append(kind)
        page.parents.append(self.stack[-1])
        self.stack.append(len(page.tags) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in BLOCKS:
            self.flush()
        if tag in HEADINGS:
            if any(self.open.get(t) for t in HEADINGS):
                self.pop(HEADINGS, CELLS)
        elif tag != "body" and self.open.get(tag):
            self.flush()
            self.pop(frozenset([tag]), CELLS - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else frozenset())

    def read(self, html: str) -> None:
        at, end, pattern = 0, html.rfind(">") + 1, TAG
        while True:
            begin = html.find("<", at, end)
            if begin < 0:
                break
            found = pattern.match(html, begin, end)
            if not found:
                # A lone < is text; one before a name opens a tag with a quote that never closes.
                if pattern is TAG and BARE_TAG.match(html, begin, end):
                    pattern = BARE_TAG
                    continue
                self.text(html[at : begin + 1])
                at = begin + 1
                continue
            self.text(html[at:begin])
            at = found.end()
            if found[2] is None:
                if found[0] == "<!--":
                    close = html.find("-->", begin + 2)
                    at = close + 3 if close >= 0 else len(html)
                continue
            tag = found[2].lower()
            if found[1]:
                self.end(tag)
            elif tag in RAW:
                at = self.skip(html, at, tag)
            else:
                self.start(tag, found[3])
            if at >= end:
                break
        self.text(html[at:])
        self.flush()

    def skip(self, html: str, at: int, tag: str) -> int:
        close = _closing(tag).search(html, at)
        stop = close.start() if close else len(html)
        if tag == "title" and not self.page.title:
            self.page.title = squeeze(unescape(html[at:stop]))
        return close.end() if close else stop


@lru_cache(maxsize=32)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.IGNORECASE)


def read(html: str) -> Page:
    return _Reader(html).page


def parts_of(page: Page) -> tuple[list[bool], list[bool] | None]:
    """Per node: is it outside the article by its name, and is it within the article (None where the page names none).

    The article is the outermost article element or, without one, the main element. Of several articles that with more
    than half of their text counts, else all. Where every article stands in something that its class names as a
    surrounding part, or in a form or header, that name means the page's layout and does not count.
    """
    size = len(page.tags)
    chars = [0] * size
    for node, text, _ in page.blocks:
        chars[node] += len(text)
    for kind in ("article", "main"):
        nodes = [i for i in range(size) if page.kinds[i] == kind]
        for waived in (False, True):
            out = [False] * size
            near: list[bool] = [False] * size  # stands in an article or main element
            if waived and not nodes:
                continue
            above: set[int] = set()
            if waived:
                at = nodes[0]
                while at >= 0:
                    above.add(at)
                    at = page.parents[at]
            for i in range(1, size):
                up, name = page.parents[i], page.kinds[i]
                near[i] = near[up] or page.kinds[up] in ("article", "main")
                out[i] = out[up] or name == "out" or name in ("named", "form") and i not in above or name == "head" and not near[i] and i not in above
            inside: list[int] = [-1] * size
            for i in range(1, size):
                up = page.parents[i]
                inside[i] = inside[up] if inside[up] >= 0 else i if page.kinds[i] == kind and not out[i] else -1
            weight: dict[int, int] = {}
            for i in range(size):
                if inside[i] >= 0:
                    weight[inside[i]] = weight.get(inside[i], 0) + (0 if out[i] else chars[i])
            if weight:
                most = max(weight, key=lambda i: (weight[i], -i))
                chosen = {most} if 2 * weight[most] > sum(weight.values()) else set(weight)
                return out, [i in chosen for i in inside]
    return parts_without_article(page), None


def parts_without_article(page: Page) -> list[bool]:
    """Per node of a page that names no article: is it outside by its name. A form with most of the text is no form."""
    size = len(page.tags)
    chars, out = [0] * size, [False] * size
    for node, text, _ in page.blocks:
        chars[node] += len(text)
    for i in range(size - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
    for i in range(1, size):
        kind = page.kinds[i]
        out[i] = out[page.parents[i]] or kind in ("out", "named", "head") or kind == "form" and 2 * chars[i] <= chars[0]
    return out
