"""The main text of web pages by composite text density.

Every block element of a page has a density: its characters per tag, raised where few of them lie in links
and lowered where many do. A node's density sum adds up its children's, so it is highest for the element
whose children are the paragraphs of the article. The lowest density on the way from there to the body is
the threshold that text elsewhere on the page must reach.

Inline markup is looked through. Elements that are no article by their name (menus, footers and the like) are
left out. Those that only say so by a word in their class, id or role, and forms, are left out unless they hold
half of the plain text or the element of highest density sum when all of them are looked at, as a wrapper around
the article may be called anything. On a page with article or main elements they must hold one of these as well,
and stay if they hold all.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")  # where a quote is never closed
HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template")}

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
DROPPED = {
    "script", "style", "nav", "header", "footer", "aside", "noscript", "template", "iframe", "svg", "math", "head", "title", "button", "select",
    "textarea", "canvas", "audio", "video", "dialog", "menu", "xmp",
}
DOUBTED = {"form", "fieldset", "map", "object"}  # left out as the elements are that HINTS names
WHOLE = 0.5  # share of the plain text with which an element is no addition to the page
HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "comment", "comments", "reply", "replies", "respond", "cookie", "cookies",
    "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related",
    "widget", "login", "signup", "search", "disqus", "contentinfo", "complementary", "alert", "toolbar", "pagination", "pager", "skip",
}
KEPT = {"html", "body", "main", "article"}  # their class speaks of the page, not of themselves
#: What an opening tag closes if it is still open, and the elements beyond which it does not look.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "html", "blockquote", "td", "th", "li", "form", "nav", "aside", "header", "footer"}


class Node:
    __slots__ = ("children", "chars", "density", "doubted", "dropped", "end", "first", "links", "link_chars", "name", "parent", "sum", "tags")

    def __init__(self, name: str, parent: Node | None, first: int):
        self.name, self.parent, self.first, self.end = name, parent, first, first
        self.children: list[Node] = []
        self.chars = self.link_chars = self.tags = self.links = 0
        self.density = self.sum = 0.0
        self.dropped = parent is not None and parent.dropped
        self.doubted = False


def _is_doubted(name: str, attributes: str) -> bool:
    if name in DOUBTED:
        return True
    if name in KEPT or "=" not in attributes:
        return False
    said = {w for m in HINT.findall(attributes) for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m).lower())}
    return not said.isdisjoint(HINTS) or ("hidden" in said and "aria" not in attributes)


class Page:
    """The block elements of a page and its text blocks, in page order."""

    def __init__(self, source: str):
        self.root = Node("html", None, 0)
        self.open: list[Node] = [self.root]
        self.nodes = [self.root]
        self.blocks: list[tuple[str, Node]] = []
        self.held: list[str] = []
        self.in_link = 0
        self.read(source)
        self.flush()
        for node in self.open:
            node.end = len(self.nodes)

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.held)).split()) if self.held else ""
        self.held = []
        if text:
            self.blocks.append((text, self.open[-1]))

    def say(self, text: str) -> None:
        if not text or self.open[-1].dropped:
            return
        self.held.append(text)
        n = len("".join(html.unescape(text).split()))
        self.open[-1].chars += n
        if self.in_link:
            self.open[-1].link_chars += n

    def close_to(self, depth: int) -> None:
        self.flush()
        for node in self.open[depth:]:
            node.end = len(self.nodes)
        del self.open[depth:]

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            if not self.open[-1].dropped:
                self.held.append(" ")
            return
        if name == "a":
            self.in_link = 1
            self.open[-1].links += 1
            self.open[-1].tags += 1
            return
        if name in INLINE or name in ("html", "wbr"):
            return
        if name == "body" and any(n.name == "body" for n in self.nodes):
            return
        if name in VOID:
            self.open[-1].tags += 1
            if name == "hr":
                self.flush()
            return
        closes, bounds = CLOSES.get(name, {"p"}), BOUNDS - CLOSES.get(name, set())
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].name in closes:
                self.close_to(depth)
                break
            if self.open[depth].name in bounds:
                break
        self.flush()
        if name == "body" and self.open[-1].name == "head":
            self.close_to(len(self.open) - 1)
        node = Node(name, self.open[-1], len(self.nodes))
        node.dropped = node.dropped or name in DROPPED
        node.doubted = not node.dropped and _is_doubted(name, attributes)
        self.open[-1].children.append(node)
        self.nodes.append(node)
        self.open.append(node)

    def stop(self, name: str) -> None:
        if name == "a":
            self.in_link = 0
            return
        if name in INLINE or name in VOID:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].name == name:
                self.close_to(depth)
                return
            if self.open[depth].name in ("article", "main", "body") and name not in ("body", "html"):
                return

    def read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            tag = source.find("<", at)
            if tag < 0:
                self.say(source[at:])
                return
            self.say(source[at:tag])
            if source.startswith("<!--", tag):
                end = source.find("-->", tag + 4)
                at = size if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), tag):
                end = source.find(">", tag)
                at = size if end < 0 else end + 1
                continue
            found = TAG.match(source, tag) or LOOSE_TAG.match(source, tag)
            if not found:
                self.say("<")
                at = tag + 1
                continue
            closing, name, attributes = found[1], found[2].lower(), found[3]
            at = found.end()
            if closing:
                self.stop(name)
            elif name in RAW:
                end = RAW[name].search(source, at)
                at = size if end is None else end.start()
                if end is not None:
                    close = source.find(">", at)
                    at = size if close < 0 else close + 1
                self.flush()
            else:
                self.start(name, attributes)

    def body(self) -> Node:
        return next((n for n in self.nodes if n.name == "body"), self.root)


def _weigh(page: Page) -> Node:
    """Totals of subtrees, densities and density sums; gives the body."""
    for node in reversed(page.nodes):
        if node.parent is not None and not node.dropped:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.links += node.links
    body = page.body()
    share = body.link_chars / max(1, body.chars)
    for node in reversed(page.nodes):
        if node.dropped or not node.chars:
            continue
        tags, links = max(1, node.tags), max(1, node.links)
        linked, plain = max(1, node.link_chars), max(1, node.chars - node.link_chars)
        base = math.log(node.chars / plain * linked + share * node.chars + math.e)
        node.density = node.chars / tags * max(0.0, math.log(max(1.0, node.chars / linked * tags / links)) / max(base, 1e-9) + 1e-9)
        kids = [c.density for c in node.children if not c.dropped]
        node.sum = sum(kids) if any(kids) else node.density
    return body


def _densest(page: Page, body: Node) -> Node | None:
    inside = [n for n in page.nodes[body.first : body.end] if not n.dropped and n.chars]
    return max(inside, key=lambda n: (n.sum, n.first)) if inside else None


def _drop_doubted(page: Page) -> None:
    """Drops doubted elements that neither are most of the page nor lead to its densest element."""
    if not any(n.doubted for n in page.nodes):
        return
    own = [(n.chars, n.link_chars, n.tags, n.links) for n in page.nodes]
    body = _weigh(page)
    leads, node = set(), _densest(page, body)
    while node is not None:
        leads.add(id(node))
        node = node.parent
    marked = [n.first for n in page.nodes if n.name in ("article", "main") and n.chars and not n.dropped]
    least = WHOLE * (body.chars - body.link_chars)
    held = [n.chars - n.link_chars for n in page.nodes]
    for node, plain, counts in zip(page.nodes, held, own, strict=True):
        node.chars, node.link_chars, node.tags, node.links = counts
        node.density = node.sum = 0.0
        inside = bisect_left(marked, node.end) - bisect_left(marked, node.first)
        kept = plain > 0 and (inside == len(marked) > 0 or ((plain >= least or id(node) in leads) and (not marked or inside > 0)))
        node.dropped = node.dropped or (node.doubted and not kept) or (node.parent is not None and node.parent.dropped)


def main_text(source: str | None) -> str:
    """Blocks of the article, each with single spaces, joined by blank lines; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    _drop_doubted(page)
    body = _weigh(page)
    best = _densest(page, body)
    if best is None:
        return ""
    threshold, node = best.density, best
    while node is not body and node.parent is not None and node.parent is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    taken: set[int] = set()
    todo = [(body, False)]
    while todo:
        node, inside_article = todo.pop()
        inside_article = inside_article or node is best or (node is not body and best is not body and node.density >= threshold)
        if inside_article:
            taken.add(id(node))
        todo += [(c, inside_article) for c in node.children if not c.dropped]
    return "\n\n".join(text for text, node in page.blocks if id(node) in taken)


def _run(batches):
    for batch in batches:
        text = [main_text(x) for x in batch["html"]]
        yield batch.drop(columns="html").assign(text=text, n_chars=[len(t) for t in text])


def extract(pages: DataFrame, *carried: Column) -> DataFrame:
    """page_id, url, the columns ``carried``, text and n_chars (code points) of every page.

    A null or empty page, or one without an article, gives an empty text. Every row is looked at for
    itself, so rows that repeat give equal results; an empty table gives an empty one; null ids and urls
    are carried along, and other columns are not looked at. Nothing is cut off at any length.
    """
    rows = pages.select("page_id", "url", *carried, F.col("html").cast("string").alias("html"))
    shape = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes[:-1])
    return rows.mapInPandas(_run, f"{shape}, text string, n_chars long")
