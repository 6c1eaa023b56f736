"""Main text of HTML pages by composite text density.

The page is parsed into a tree that repairs unclosed elements. Each node has its characters, tags,
link characters and link tags; its composite density is characters per tag, lowered the more of it
is links (Sun et al., "DOM Based Content Extraction via Text Density", 2011). A node's sum is the
density of its children added up. The node of the largest sum is the core of the article, whatever
its name. From there the way goes up towards the body as long as link-adjusted characters per tag
stay at ``PATH_SHARE`` of the core's, which brings in the other sections; what that node holds is the
text, but for lists of links under the least density on the path to the body.

Furniture has no density and gives no text: elements that are by their name (menus, footers, asides,
forms, scripts and so on, headers outside of an article) and containers of which a whole word of
class, id or role says so. A form or so named container that holds an article, a main part or a first
heading is a wrapper and no furniture; so is a container's own header with a first heading, a form with most of the page's characters,
a container with most of them whose words are ``AMBIGUOUS``, and all of these where nothing else has text. Inline elements are never furniture.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold text of the page.
SILENT = frozenset("script style noscript template title iframe object svg math canvas audio video select textarea".split())
#: Elements that are furniture by their name; of these, forms can be wrappers.
BY_NAME = frozenset("nav aside footer dialog menu button form fieldset".split())
#: These end with the element that holds them or where a block starts.
SHORT = frozenset("button title iframe object svg math canvas audio video select textarea".split())
#: Opening one of these ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Opening the key ends open ones of the value, up to a border.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
BORDER = frozenset("table ul ol dl article section main div body aside nav footer header form blockquote".split())
#: Elements that class, id and role can make furniture.
CONTAINERS = frozenset("div section ul ol dl table p li header figure".split())
#: Whole words of class, id and role that mark furniture.
FURNITURE = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navigation navbar menu menus menu-item breadcrumb breadcrumbs sidebar side-bar footer
    site-header page-header site-footer page-footer site-nav main-nav masthead topbar cookie cookies cookie-notice cookie-banner cookie-bar consent gdpr notice notices newsletter subscribe subscription signup
    login popup modal overlay comments comment-list commentlist comment-section replies respond disqus disqus_thread share sharing share-buttons social social-links related related-posts related-articles
    recommended recommendations widget widgets toolbar pagination pager search search-form searchbox complementary contentinfo dialog alert paywall skip-link""".split()
)
#: Of these, words that articles' containers bear as well: they mark no node with most of the page's text.
AMBIGUOUS = frozenset("notice notices banner promo promotion overlay modal popup social toolbar alert dialog widget widgets search".split())
#: Share of the core's characters per tag at which a node on the way up still belongs to it.
PATH_SHARE = 0.5
_SPACE = re.compile(r"\s+")
_OPEN = re.compile(r"<[A-Za-z/?!]")


class Node:
    __slots__ = ("tag", "kids", "mark", "inside", "chars", "tags", "link_chars", "link_tags", "head", "density", "total", "best")

    def __init__(self, tag: str, inside: bool = False):
        self.tag, self.kids, self.mark, self.inside = tag, [], "", inside or tag in ("article", "main")
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.head, self.density, self.total, self.best = tag in ("article", "main", "h1"), 0.0, 0.0, self


class _Tree(HTMLParser):
    """The tree of a page. The stack holds what is open, ``count`` how many of each name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body = Node("body")
        self.stack: list[Node] = [self.body]
        self.count: Counter[str] = Counter()
        self.unclosed = self.unended = False

    def parse_comment(self, i: int, report: bool = True) -> int:
        if self.unclosed:  # no comment ends after one that has no end
            return -1
        at = super().parse_comment(i, report)
        self.unclosed = at < 0
        return at

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        if self.unended:
            return -1
        at = super().parse_marked_section(i, report)
        self.unended = at < 0
        return at

    def set_cdata_mode(self, elem: str, **kwargs) -> None:
        if elem in ("script", "style"):
            super().set_cdata_mode(elem, **kwargs)

    def _pop(self) -> str:
        tag = self.stack.pop().tag
        self.count[tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body"):
            while tag == "body" and len(self.stack) > 1:
                self._pop()
            return
        if tag == "br":
            self.stack[-1].kids.append(" ")
            return
        if tag in BLOCKS or tag in ENDS:
            # a block ends short elements and inline ones, but for a link, which may hold blocks
            while len(self.stack) > 1 and (self.stack[-1].tag in SHORT or self.stack[-1].tag in INLINE and self.stack[-1].tag != "a"):
                self._pop()
        if tag in BLOCKS:
            self._close_open({"p"})
        if tag in ENDS:
            self._close_open(ENDS[tag])
        if tag == "a" and self.count["a"]:
            self.handle_endtag("a")
        if tag in VOID:
            return
        node = Node(tag, self.stack[-1].inside)
        if tag in SILENT:
            node.mark = "silent"
        elif tag == "header" and not node.inside and len(self.stack) > 1:
            node.mark = "header"  # a container's own
        elif tag in BY_NAME or tag == "header" and not node.inside or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            node.mark = "form" if tag == "form" else "name"
        elif tag in CONTAINERS and (words := {w.lower() for k, v in attrs if v and k in ("class", "id", "role") for w in v.split()} & FURNITURE):
            node.mark = "maybe" if words <= AMBIGUOUS else "word"
        self.stack[-1].kids.append(node)
        self.stack.append(node)
        self.count[tag] += 1

    def _close_open(self, tags: set[str]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in BORDER:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:
            while self._pop() != tag:
                pass

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SHORT:  # of other elements the slash means nothing
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.stack[-1].kids.append(data)


def _ordered(body: Node) -> list[tuple[Node, bool]]:
    """Nodes, parents first, and whether they are within a link; without recursion."""
    order, todo = [], [(body, False)]
    while todo:
        node, link = todo.pop()
        order.append((node, link))
        todo += [(k, link or k.tag == "a") for k in node.kids if isinstance(k, Node)]
    return order


def _count(order: list[tuple[Node, bool]]) -> None:
    """Characters, tags and their links of every node, without marked ones below it."""
    for node, link in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                n = len(_SPACE.sub(" ", k).strip())
                node.chars += n
                node.link_chars += n * link
            elif not k.mark:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")


def _unwrap(order: list[tuple[Node, bool]]) -> None:
    """Takes the mark off forms and containers that are wrappers."""
    heads: dict[int, bool] = {}
    size: dict[int, int] = {}
    for node, _ in reversed(order):
        kids = [k for k in node.kids if isinstance(k, Node) and k.mark not in ("silent", "name")]
        heads[id(node)] = node.head or any(heads[id(k)] for k in kids)
        size[id(node)] = sum(len(k.strip()) for k in node.kids if isinstance(k, str)) + sum(size[id(k)] for k in kids)
    for node, _ in order:
        if node.mark in ("form", "word", "maybe", "header") and heads[id(node)] or node.mark in ("form", "maybe") and 2 * size[id(node)] > size[id(order[0][0])]:
            node.mark = ""


def _measure(order: list[tuple[Node, bool]]) -> None:
    """Densities, sums, and the node of the largest sum in each subtree, the outermost of equals."""
    body = order[0][0]
    share = body.link_chars / max(1, body.chars)
    for node, _ in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)), max(base, 1.0001))
        kids = [k for k in node.kids if isinstance(k, Node) and not k.mark]
        node.total = sum(k.density for k in kids)
        for k in kids:
            if k.best.total > node.best.total:
                node.best = k.best


def _article(body: Node, order: list[tuple[Node, bool]]) -> tuple[Node, float]:
    """The node that holds the text, and the least density on its path to the body."""
    above = {id(k): node for node, _ in order for k in node.kids if isinstance(k, Node)}
    plain = lambda n: (n.chars - n.link_chars) / max(1, n.tags)
    top = body.best
    least = PATH_SHARE * plain(top)
    while top is not body and above[id(top)] is not body and plain(above[id(top)]) >= least:
        top = above[id(top)]
    threshold, node = top.density, top
    while node is not body:
        node = above[id(node)]
        threshold = min(threshold, node.density)
    return top, threshold


def extract(html: str | None) -> str:
    """Main text of a page: its blocks in page order, one a line, white space within them as single
    spaces."""
    html = html or ""
    tag = _OPEN.search(html, html.rfind(">") + 1)  # a tag that the page ends in is none
    tree = _Tree()
    tree.feed(html if tag is None else html[: tag.start()])
    tree.close()
    order = _ordered(tree.body)
    _unwrap(order)
    _count(order)
    if not tree.body.chars:
        for node, _ in order:
            node.mark = "" if node.mark in ("form", "word", "maybe") else node.mark
        _count(order)
    _measure(order)
    top, threshold = _article(tree.body, order)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            blocks.append(text)
        run.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.mark:
            if x.tag not in INLINE:
                if x is not top and 2 * x.link_chars > x.chars and x.link_tags > 1 and x.density <= threshold:
                    continue  # a menu that carries no mark
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col`` and with ``text_col`` (empty if there is none) and ``n_chars``
    (its code points). Null counts as an empty page; columns of those names are replaced, others and
    repeated rows stay; an empty table gives an empty result."""
    kept = pages.drop(*({text_col, "n_chars"} - {html_col}))
    at = kept.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(at)]
            rest = [i for i in range(b.num_columns) if i != at]
            cols = [*(b.column(i) for i in rest), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(b.schema.names[i] for i in rest), text_col, "n_chars"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != html_col]
    return kept.mapInArrow(run, ", ".join([*fields, f"`{text_col}` string", "n_chars long"]))
