"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each element gets its characters per tag, adjusted
for characters and tags inside links; each element's score is the sum of its children's
densities. The subtree of the largest score, widened to those of its ancestors below
body that are at least a third as dense, is the content, together with the largest subtrees
under every element as dense as the sparsest one on the path from it to body.

Elements that can't hold an article (menus, footers, scripts) are left out of the tree.
Names of classes and ids only make a subtree's densities count less; the subtree goes
when the content turns out to lie elsewhere.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.llm.batches import bounded_batches

# Quotes count only where a value begins, as in HTML: a stray one is a character like others.
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?|[^>=])*)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s]*)))?""")
_NOT_SHOWN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")

# Names of HTML elements, and words that pages use for what is not their main text.
_RAW = frozenset("script style noscript template textarea title iframe object svg math canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_DROPPED = frozenset("head nav footer aside button select menu dialog label audio video map".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar"
    " aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " recommendations comment comments disqus reply replies respond pagination pager widget toolbar topbar masthead skip".split()
)
# Words that say nothing of their own. A compound with any other word names that, and no boilerplate ("related-work", "notice-board", "menu-of-the-day").
_PLAIN = frozenset(
    "site main page top bottom left right box block list area section container wrapper wrap inner outer link links post posts article articles story stories item items form button buttons"
    " bar col column row header title text unit slot sticky fixed primary secondary global panel group holder thread media icons the to us my and in on reader readers user users visitor visitors guest guests blog news web mail email js".split()
)
# Words that make a compound name a page's layout or state ("has-sidebar", "comments-open"), not a part of it.
_LAYOUT = frozenset("has no not with without open closed free enabled disabled target story".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What densities inside a named subtree count; characters of a story that are told in spite of its name; density of an ancestor that belongs to the content.
_DOUBT, _STORY, _WIDER = 0.1, 200, 1 / 3
_HOLDS = ("article", "main")
#: Dropped elements that are words of their sentence inside of a paragraph.
_IN_LINE = frozenset("button label".split())
#: Elements whose start ends an open element of the same group below the given boundary.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_CLOSES = {k: (tuple(names.split()), edge) for k, (names, edge) in _CLOSES.items()}


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "link_chars", "tags", "link_tags", "density", "score", "best", "inside", "named", "doubt")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.items = tag, parent, []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.score = 0.0
        self.best, self.inside, self.named, self.doubt = self, False, False, 1.0


def _attributes(raw: str) -> dict[str, str]:
    """Names in lower case; the first of a name counts, one without a value is empty."""
    found: dict[str, str] = {}
    if "=" in raw or "hidden" in raw:
        for m in _ATTRIBUTE.finditer(raw):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element is boilerplate whatever it holds."""
    if tag in _DROPPED or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(attributes.get("style", "")):
        return True
    return tag not in (*_HOLDS, "body", "html") and attributes.get("role", "").strip().lower() in _ROLES


def _named(tag: str, attributes: dict[str, str]) -> bool:
    """Whether the element is a form, or a class or the id names boilerplate."""
    if tag in ("form", "fieldset"):
        return True
    if tag in _HOLDS:
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = {p.lower() for p in _PART.findall(name)}
        if parts & _WORDS and not parts & _LAYOUT and all(p in _WORDS or p in _PLAIN or len(p) <= 2 for p in parts):
            return True
    return False


class _Open:
    """The open elements, and how deep those of each name and the innermost blocks are: what a tag ends is found without climbing."""

    def __init__(self, root: Node):
        self.path, self.by_name, self.blocks, self.solid = [root], {}, [], []

    @property
    def now(self) -> Node:
        return self.path[-1]

    def push(self, node: Node) -> None:
        depth = len(self.path)
        self.path.append(node)
        self.by_name.setdefault(node.tag, []).append(depth)
        if node.tag in _BLOCK:
            self.blocks.append(depth)
            if node.tag != "p":
                self.solid.append(depth)

    def cut(self, depth: int) -> None:
        """End all elements from this depth on."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.by_name[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
                if tag != "p":
                    self.solid.pop()

    def innermost(self, tag: str) -> int:
        """The depth of the innermost open element of this name, 0 if there is none. An inline end tag doesn't reach out of its block."""
        depth = (self.by_name.get(tag) or (0,))[-1]
        return 0 if depth and tag not in _BLOCK and self.blocks and self.blocks[-1] > depth else depth

    def end(self, names: tuple[str, ...], edge: int) -> None:
        """End the outermost element of these names that is deeper than ``edge``."""
        found = [held[i] for held in map(self.by_name.get, names) if held and (i := bisect_right(held, edge)) < len(held)]
        if found:
            self.cut(min(found))

    def deepest(self, names: tuple[str, ...]) -> int:
        return max((held[-1] for held in map(self.by_name.get, names) if held), default=0)


def parse(html: str) -> Node:
    """The body as a tree without boilerplate; items are strings and elements in page order."""
    root = Node("body", None)
    stack = _Open(root)
    skip: str | None = None  # inside a dropped element of this name, so deep
    depth = 0
    at = 0
    find = _TOKEN.search
    while True:
        m = find(html, at)
        text = html[at : m.start() if m else len(html)]
        if text and skip is None:
            stack.now.items.append(unescape(text) if "&" in text else text)
        if m is None:
            return root
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if not m[4]:
            return root  # a tag that the page breaks off in
        if not ends and tag in _RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if skip is not None:
            if tag == skip:
                depth += -1 if ends else 1
                if depth == 0:
                    skip = None
            elif ends and tag in ("body", "html"):
                skip = None
            continue
        if ends:
            if tag == "br" or tag == "p" and not stack.innermost("p"):
                stack.now.items.append(Node("br", stack.now))
            elif tag not in ("body", "html"):
                found = stack.innermost(tag)
                if found:
                    stack.cut(found)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _BLOCK and tag != "br":
            stack.end(("p",), stack.solid[-1] if stack.solid else 0)
        if tag in _CLOSES:
            names, edge = _CLOSES[tag]
            stack.end(names, stack.deepest(edge))
        attributes = _attributes(m[3])
        in_line = tag in _IN_LINE and stack.blocks and stack.path[stack.blocks[-1]].tag == "p"  # words of a sentence
        if not in_line and _boilerplate(tag, attributes, stack.deepest(_HOLDS) > 0):
            if tag not in _VOID and not m[3].endswith("/"):
                skip, depth = tag, 1
            stack.now.items.append(Node("br", stack.now))
            continue
        node = Node(tag, stack.now)
        node.named = not in_line and _named(tag, attributes)
        stack.now.items.append(node)
        if tag not in _VOID and not m[3].endswith("/"):
            stack.push(node)


def _elements(root: Node) -> list[Node]:
    """All elements, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in node.items if type(x) is Node]
    return out


def score(root: Node) -> list[Node]:
    """Fill in the counts, densities and scores; the elements, parents first."""
    nodes = _elements(root)
    for node in nodes:
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        node.density, node.best = 0.0, node
    for node in reversed(nodes):
        node.chars += sum(len("".join(x.split())) for x in node.items if type(x) is str)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + (node.tag != "br")
            up.link_tags += node.link_tags
    ratio = root.link_chars / max(root.chars, 1)
    for node in nodes:
        if node.chars:
            tags, links, link_tags = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + ratio * node.chars + math.e)
            node.density = node.chars / tags * math.log(node.chars / links * tags / link_tags + 1) / math.log(base + 1)
    for node in nodes:
        node.doubt = (node.parent.doubt if node.parent is not None else 1.0) * (_DOUBT if node.named else 1.0)
    for node in nodes:
        node.score = sum(x.density * x.doubt for x in node.items if type(x) is Node)
    for node in reversed(nodes):  # the element of the largest score in each subtree
        up = node.parent
        if up is not None and node.best.score > up.best.score:
            up.best = node.best
    return nodes


def _believed(root: Node, nodes: list[Node], best: Node) -> bool:
    """Drop the named subtrees that the densest one does not lie in, or that are too short for a story; whether any was dropped."""
    around, node = set(), best
    while node is not None:
        if best.chars - best.link_chars >= _STORY:
            around.add(id(node))
        node = node.parent
    found = False
    for node in nodes:
        if node.named and id(node) not in around:
            node.tag, node.items, node.named, found = "br", [], False, True
        elif node.named:
            node.named = False
    return found


def content(root: Node) -> list[Node]:
    """The outermost elements that hold the main text, in page order."""
    nodes = score(root)
    if any(n.named for n in nodes):
        _believed(root, nodes, root.best)
        nodes = score(root)
    best = root.best
    if best.score <= 0:
        return [root]
    enough = _WIDER * best.density
    while best.parent is not None and best.parent.parent is not None and best.parent.density >= enough:
        best = best.parent
    least, node, marked = best.density, best, {id(best)}
    while node.parent is not None:
        for x in node.parent.items:  # a headline beside the content
            if x is node:
                break
            if type(x) is Node and x.tag == "h1":
                marked.add(id(x))
        node = node.parent
        least = min(least, node.density)
    marked |= {id(n.best if n.best.score > 0 else n) for n in nodes if n.density >= least and n is not root}
    out = []
    for node in nodes:
        node.inside = node.parent is not None and (node.parent.inside or id(node.parent) in marked)
        if id(node) in marked and not node.inside:
            out.append(node)
    return out


def blocks(node: Node) -> list[str]:
    """The text of the blocks under ``node``, white space as one space, without empty ones."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            line = " ".join("".join(run).split())
            if line:
                out.append(line)
            run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if type(x) is str:
            run.append(x)
        elif x is None:
            flush()
        else:
            if x.tag in _BLOCK:
                flush()
                todo.append(None)
            todo += x.items[::-1]
    flush()
    return out


def main_text(html: str | None) -> str:
    root = parse(html or "")
    kept = content(root)
    if len(kept) > 1:
        order = {id(n): i for i, n in enumerate(_in_page_order(root))}
        kept.sort(key=lambda n: order[id(n)])
    return "\n".join(line for node in kept for line in blocks(node))


def _in_page_order(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in reversed(node.items) if type(x) is Node]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]  # one page at a time
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    A null or empty html has an empty text; broken and cut-off markup is read as far as
    it goes; whole pages of any length are read; repeated rows and other columns change
    nothing. No shuffle: every page is handled where it is read.
    """
    bounded_batches(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return slim.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of ``pages``; nulls, broken pages, repeats and empty tables as in ``extract_text``."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
