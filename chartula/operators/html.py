"""HTML pages to chunks: the first heading, then each selected node with the heading before it."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements without content, and elements that a new block closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def texts(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style"):
                yield from c.texts()

    def nodes(self) -> Iterator[Node]:
        for c in self.children:
            if not isinstance(c, str):
                yield c
                yield from c.nodes()

    def before(self, tag: str) -> Node | None:
        """The nearest earlier sibling of that tag."""
        if self.parent is None:
            return None
        found = None
        for c in self.parent.children:
            if c is self:
                return found
            if not isinstance(c, str) and c.tag == tag:
                found = c
        return None


class _Tree(HTMLParser):
    """A tree that forgives: a block closes an open paragraph, an unknown end tag is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag == "li":
            self._close("li" if tag == "li" else "p", {"ul", "ol"} if tag == "li" else set())
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _close(self, tag: str, stop: set[str]) -> None:
        n = self.at
        while n.parent is not None and n.tag not in stop:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_endtag(self, tag):
        self._close(tag, set())

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _matches(node: Node, step: str) -> bool:
    if step.startswith("["):
        name, _, value = step[1:-1].partition("=")
        return name in node.attrs and (not value or node.attrs[name] == value.strip("\"'"))
    return node.tag == step


def select(root: Node, selector: str) -> Iterator[Node]:
    """Nodes in document order; selector: tags and [name=value], each below the one before it."""
    *above, last = selector.split()
    for n in root.nodes():
        if _matches(n, last):
            left, up = list(above), n.parent
            while left and up is not None:
                if _matches(up, left[-1]):
                    left.pop()
                up = up.parent
            if not left:
                yield n


def spaced(node: Node) -> str:
    return " ".join("".join(node.texts()).split())


def page_chunks(html: str, selector: str = "[data-template=xText]", heading: str = "h3", first: str = "1.") -> list[str]:
    """The texts of a page: its first h1, if any, then the selected nodes.

    A node takes the nearest earlier ``heading`` among its parent's siblings before it; is that just ``first``, the one
    before the parent's grandparent comes ahead of it.
    """
    root = parse(html)
    body = next((n for n in root.nodes() if n.tag == "body"), root)
    out = []
    if (h1 := next((n for n in body.nodes() if n.tag == "h1"), None)) is not None:
        out.append("".join(t.strip() for t in h1.texts()))
    for node in select(body, selector):
        text, parent = spaced(node), node.parent
        if parent is not None and (h := parent.before(heading)) is not None:
            name = spaced(h)
            text = f"{name} {text}"
            up = parent.parent.parent if parent.parent is not None else None
            if name == first and up is not None and (above := up.before(heading)) is not None:
                text = f"{spaced(above)} {text}"
        out.append(text)
    return out


def raw_heading(html: Column) -> Column:
    """What the source has between the first h1's tags, trimmed: of all markup only ``&amp;`` is read. Null without such a tag,
    empty where it isn't closed; page_chunks() gives the heading's text."""
    inner = F.regexp_extract(html, "(?s)<h1[^>]*>(.*?)</h1>", 1)
    return F.when(html.rlike("<h1[ >]"), F.trim(F.replace(inner, F.lit("&amp;"), F.lit("&"))))


def html_chunks(pages: DataFrame, **options) -> DataFrame:
    """(chunk_id, chunk) of pages (stem, html): ids are the stem and a running number; null pages have no chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f"{stem}_{i}", text) for stem, html in zip(pdf["stem"], pdf["html"]) for i, text in enumerate(page_chunks(html, **options))]
            yield pd.DataFrame(rows, columns=["chunk_id", "chunk"])

    return pages.select("stem", "html").filter("html IS NOT NULL").mapInPandas(run, "chunk_id string, chunk string")
