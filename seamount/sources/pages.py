"""Image records of raw pages: a small tree of each page, and the forms in which images stand in an article."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame

from .collections import IMAGE

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose strings are no text of what is around them.
SILENT = frozenset(("script", "style", "template"))


class Node:
    """An element, or a string (name is None) with its text; ``start`` and ``stop`` bound what is in it in the page's order."""

    __slots__ = ("name", "attrs", "text", "parent", "place", "start", "stop", "kids", "near")

    def __init__(self, name: str | None, attrs: dict[str, str], text: str, parent: Node | None, start: int):
        self.name, self.attrs, self.text, self.parent, self.start, self.stop = name, attrs, text, parent, start, start + 1
        self.place = len(parent.kids) if parent else 0
        self.kids: list[Node] = []
        self.near: dict[str, tuple[list[Node | None], list[Node | None]]] = {}
        if parent:
            parent.kids.append(self)

    def is_a(self, what: str) -> bool:
        """Whether it is a ``name`` or ``name.class``."""
        name, _, of = what.partition(".")
        return self.name == name and (not of or of in self.attrs.get("class", "").split())


class Tree(HTMLParser):
    """The nodes of a page in order. An end tag closes the last open element of its name, and what is open in it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", {}, "", None, 0)]
        self.open, self.names = [self.nodes[0]], Counter()
        self.feed(html)
        self.close()
        self._close_to(0)

    def _add(self, name: str | None, attrs: dict[str, str], text: str) -> Node:
        node = Node(name, attrs, text, self.open[-1], len(self.nodes))
        self.nodes.append(node)
        return node

    def _close_to(self, size: int) -> None:
        while len(self.open) > size:
            node = self.open.pop()
            node.stop = len(self.nodes)
            self.names[node.name] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = self._add(tag, {k: v or "" for k, v in attrs}, "")
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._add(tag, {k: v or "" for k, v in attrs}, "")

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag] > 0:
            at = len(self.open) - 1
            while self.open[at].name != tag:
                at -= 1
            self._close_to(at)

    def handle_data(self, data: str) -> None:
        self._add(None, {}, data)

    def inside(self, node: Node) -> list[Node]:
        return self.nodes[node.start + 1 : node.stop]

    def all(self, node: Node, what: str) -> Iterator[Node]:
        return (n for n in self.inside(node) if n.is_a(what))

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.nodes if test(n)), None)

    def text(self, node: Node | None, strip: bool = True) -> str:
        """The strings in an element, in order; with ``strip`` each is trimmed."""
        strings = [n.text for n in self.inside(node) if n.name is None and n.parent.name not in SILENT] if node else []
        return "".join(s.strip() for s in strings) if strip else "".join(strings)


def sibling(node: Node, what: str, after: bool = True) -> Node | None:
    """The next (or last before) sibling of a kind; the kinds' places are noted once for each parent."""
    near = node.parent.near
    if what not in near:
        kids, before, behind = node.parent.kids, [], []
        for n in kids:
            before.append(n if n.is_a(what) else before[-1] if before else None)
        for n in reversed(kids):
            behind.append(n if n.is_a(what) else behind[-1] if behind else None)
        near[what] = (before, behind[::-1])
    before, behind = near[what]
    at = node.place + 1 if after else node.place - 1
    return (behind if after else before)[at] if 0 <= at < len(behind) else None


def images(url: str | None, html: str | None) -> list[tuple]:
    """The image records of a page, in the columns of :data:`IMAGE`; none without an element ``div#bodyContent``.

    Three forms: images of the first ``table`` whose class is ``infobox biota``; the first image of links in
    ``div.thumbimage`` of each ``div.thumb``; images of links in each ``figure``. Images without src are left out.
    """
    tree, url = Tree(html or ""), url or ""
    body = tree.first(lambda n: n.name == "div" and n.attrs.get("id") == "bodyContent")
    if body is None:
        return []
    text = tree.text(body) or "No body text"
    heading = tree.first(lambda n: n.name == "h1" and n.attrs.get("id") == "firstHeading")
    title = tree.text(heading) if heading else "No title"
    links = tree.first(lambda n: n.attrs.get("id") == "mw-normal-catlinks")
    categories = [tree.text(a) for a in tree.all(links, "a") if a.parent.name == "li" and any(x.name == "ul" for x in _above(a.parent, links))] if links else []
    found: list[tuple] = []

    def add(image: Node | None, alt: str, named: str, around: str, caption: str) -> None:
        if image is not None and "src" in image.attrs:
            found.append((url, title, categories, _joined(url, image.attrs["src"]), alt, named, text, around, caption))

    box = tree.first(lambda n: n.name == "table" and n.attrs.get("class") == "infobox biota")
    if box:
        p = sibling(box, "p")
        for image in tree.all(box, "img"):
            add(image, image.attrs.get("alt", "").strip(), "", tree.text(p) if p else title, "Infobox Image")
    for thumb in tree.all(body, "div.thumb"):
        p = sibling(thumb, "p")
        for frame in tree.all(thumb, "div.thumbimage"):
            caption = sibling(frame, "div.thumbcaption")
            for link in tree.all(frame, "a"):
                if "href" in link.attrs:
                    add(next(tree.all(link, "img"), None), frame.attrs.get("alt", "").strip(), frame.attrs.get("title", "").strip(), tree.text(p) if p else "No surrounding text", tree.text(caption) if caption else "No caption available")
    for figure in tree.all(body, "figure"):
        before, behind = (tree.text(sibling(figure, "p", after), strip=False) for after in (False, True))
        for link in tree.all(figure, "a"):
            if "href" in link.attrs:
                caption = sibling(link, "div.thumbcaption") or sibling(link, "figcaption")
                for image in tree.all(link, "img"):
                    add(image, image.attrs.get("alt", ""), image.attrs.get("title", ""), f"{before} {behind}" if before or behind else "No surrounding text", tree.text(caption) if caption else "No caption available")
    return found


def _above(node: Node, top: Node) -> Iterator[Node]:
    """The elements around a node, below ``top``."""
    while (node := node.parent) is not top:
        yield node


def _joined(base: str, link: str) -> str:
    """An address resolved; one that can't be parsed stays as it is."""
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def page_images(pages: DataFrame) -> DataFrame:
    """The image records of pages (url, html), a row for each image; a null html has none, a null url is empty."""

    def parse(batches):
        import pandas as pd

        names = [c.split()[0] for c in IMAGE.split(", ")]
        for pdf in batches:
            for url, html in zip(pdf["url"], pdf["html"]):
                rows = images(url, html)
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return pages.select("url", "html").mapInPandas(parse, IMAGE)
