"""Pages as trees: a forgiving parser, selectors with ancestors, main content, navigation metadata.

A page becomes a tree of nodes that know their parent. Selectors are those of style sheets as far as
pages need them: tags, .class, #id, [attribute], [attribute=value], descendants, children (>) and
lists (,). What the columns hold is said at page_documents().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from ..batches import pieces
from ..shipping import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are no text of the page.
RAW = frozenset(("script", "style", "template"))
#: What normalised text leaves out, and where main content is looked for, in order.
LEFT_OUT = frozenset(("script", "style", "nav", "header", "footer"))
MAIN_SELECTORS = ("main", "article", '[role="main"]', ".content", ".main-content", "#content", "#main", ".post-content", ".entry-content")
#: Characters that main content must exceed.
MAIN_LEAST = 100
#: Links in normalised text as 'text (см. address)'.
LINKS = ((re.compile(r"\[([^\]]+)\]\(([^)]+)\)"), r"\1 (см. \2)"), (re.compile(r'<a[^>]+href="([^"]+)"[^>]*>([^<]+)</a>'), r"\2 (см. \1)"))


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This node and all below, in the order of the page (without recursion: pages may be deep)."""
        left = [self]
        while left:
            node = left.pop()
            yield node
            left += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self, left_out: frozenset[str] = RAW) -> Iterator[str]:
        """Pieces of text below, white space stripped, empty ones left out."""
        left: list[Node | str] = list(reversed(self.children))
        while left:
            x = left.pop()
            if isinstance(x, str):
                if x := x.strip():
                    yield x
            elif x.tag not in left_out and x.tag not in RAW:
                left += reversed(x.children)

    def text(self, separator: str = "\n", left_out: frozenset[str] = RAW) -> str:
        return separator.join(self.strings(left_out))

    def find(self, tag: str, left_out: frozenset[str] = frozenset()) -> Node | None:
        """The first such element below that stands in none of left_out."""
        for node in self.walk():
            if node.tag == tag and not (left_out and any(a.tag in left_out for a in node.ancestors())):
                return node
        return None

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def select(self, selector: str) -> list[Node]:
        """Elements below that match, in the order of the page."""
        chains = compiled(selector)
        return [n for n in self.walk() if n is not self and any(_matches(n, c) for c in chains)]

    def select_one(self, selector: str) -> Node | None:
        chains = compiled(selector)
        return next((n for n in self.walk() if n is not self and any(_matches(n, c) for c in chains)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root
        self.open: dict[str, int] = {}  # open elements by tag, so that stray end tags cost nothing
        self.data: list[str] = []  # text that no markup divides is one piece, in however many parts it comes

    def flush(self, *_):
        if self.data:
            self.at.children.append("".join(self.data))
            self.data = []

    handle_comment = handle_decl = unknown_decl = handle_pi = flush

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.at.children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag):
        self.flush()
        if not self.open.get(tag):
            return
        while True:
            closed, self.at = self.at.tag, self.at.parent
            self.open[closed] -= 1
            if closed == tag:
                return

    def handle_data(self, data):
        self.data.append(data)


#: Ampersands but for &amp, and the reference that follows, if it has its semicolon.
_REFERENCE = re.compile(r"&(?!amp)(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _whole_references(text: str) -> str:
    """text where the other ampersands are spelled out, so that they stay."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], text)


def parse(text: str, whole: bool = False) -> Node:
    """The tree of a page. Elements left open end with what holds them; end tags without a start are passed over. With whole,
    character references that lack their semicolon (but for &amp) are text."""
    builder = _Builder()
    builder.feed(_whole_references(text) if whole else text)
    builder.close()
    builder.flush()
    return builder.root


# ---------------------------------------------------------------- selectors

_SIMPLE = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:=\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]""")
_STEP = re.compile(r"\s*(>)\s*|\s+")


class Compound:
    """One element's conditions."""

    def __init__(self, text: str):
        self.tag, self.classes, self.wanted = None, [], []
        at = 0
        while at < len(text):
            m = _SIMPLE.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"no selector: {text!r}")
            if m["tag"]:
                self.tag = None if m["tag"] == "*" else m["tag"].lower()
            elif m["cls"]:
                self.classes.append(m["cls"])
            elif m["id"]:
                self.wanted.append(("id", m["id"]))
            else:
                self.wanted.append((m["attr"].lower(), next((x for x in (m["dq"], m["sq"], m["bare"]) if x is not None), None)))
            at = m.end()
        if not text:
            raise ValueError("an empty selector")

    def holds(self, node: Node) -> bool:
        if self.tag and node.tag != self.tag:
            return False
        if self.classes and not set(self.classes) <= set(node.attrs.get("class", "").split()):
            return False
        return all(k in node.attrs and (v is None or node.attrs[k] == v) for k, v in self.wanted)


@cache
def compiled(selector: str) -> list[list[tuple[str, Compound]]]:
    """For each selector of a list: (relation to what stands left of it, conditions), rightmost first."""
    out = []
    for one in selector.split(","):
        parts, relation, at = [], "", 0
        one = one.strip()
        for m in [*_STEP.finditer(re.sub(r"\[[^\]]*\]", lambda b: "x" * len(b[0]), one)), None]:
            parts.append((relation, Compound(one[at : m.start() if m else len(one)])))
            if m:
                relation, at = ">" if m[1] else " ", m.end()
        out.append(parts[::-1])
    return out


def _matches(node: Node, chain: list[tuple[str, Compound]]) -> bool:
    """Whether node meets the rightmost conditions and its ancestors the others. Descendants may have to be tried again
    further up, so the ancestors at which each part of the chain can stand are kept as a set."""
    if not chain[0][1].holds(node):
        return False
    at = [node]
    for (relation, _), (_, wanted) in zip(chain, chain[1:], strict=False):
        above = [n.parent for n in at] if relation == ">" else list(dict.fromkeys(a for n in at[:1] for a in n.ancestors()))
        at = [a for a in above if a is not None and a.tag and wanted.holds(a)]
        if not at:
            return False
    return True


# ---------------------------------------------------------------- what a page says


def normalised_text(root: Node) -> str:
    """Text of the first main, article or body, or else of all, without navigation; links spelled out."""
    place = next((n for t in ("main", "article", "body") if (n := root.find(t, LEFT_OUT))), root)
    text = place.text("\n", LEFT_OUT)
    for pattern, to in LINKS:
        text = pattern.sub(to, text)
    return text


def main_content(root: Node, fallback: str = "") -> tuple[str, str]:
    """(selector, text): the first of MAIN_SELECTORS whose first element holds more than MAIN_LEAST characters, else body, else the fallback."""
    for selector in MAIN_SELECTORS:
        node = root.select_one(selector)
        if node and len(text := node.text()) > MAIN_LEAST:
            return selector, text
    body = root.find("body")
    return ("body", body.text()) if body else ("", fallback)


def breadcrumbs(root: Node) -> list[str]:
    return [n.text(" ") for n in root.select(".theme-doc-breadcrumbs a")]


def section_headers(root: Node) -> list[str]:
    return [n.text(" ") for n in root.select(".theme-doc-markdown h2, .theme-doc-markdown h3")]


def permissions(root: Node) -> list[str]:
    """What follows the last 'Permissions' in bold that text follows, split at commas."""
    found: list[str] = []
    for node in root.walk():
        if node.tag == "strong" and "Permissions" in node.text(" "):
            beside = node.parent.children
            after = next((i for i, c in enumerate(beside) if c is node)) + 1
            if after < len(beside) and isinstance(beside[after], str):
                found = [p.strip() for p in beside[after].split(",") if p.strip()] or found
    return found


def meta(root: Node, name: str) -> str | None:
    node = next((n for n in root.walk() if n.tag == "meta" and n.attrs.get("name") == name), None)
    return node.attrs.get("content", "") if node else None


def links(root: Node, url: str) -> list[str]:
    """Addresses of all links, absolute and without fragments, in the order of the page, repeats included."""
    out = []
    for node in root.walk():
        if node.tag == "a" and node.attrs.get("href"):
            try:
                out.append(urldefrag(urljoin(url, node.attrs["href"]))[0])
            except ValueError:  # no address
                continue
    return out


_COLUMNS = (
    ("title", pa.string()), ("text", pa.string()), ("selector", pa.string()), ("main", pa.string()), ("lang", pa.string()), ("description", pa.string()),
    ("keywords", pa.string()), ("breadcrumbs", pa.list_(pa.string())), ("section_headers", pa.list_(pa.string())), ("permissions", pa.list_(pa.string())),
    ("links", pa.list_(pa.string())),
)


def _page(root: Node, url: str, names: tuple[str, ...]) -> tuple:
    """The named columns of a page; what no name asks for is not looked for."""
    found: dict = {}
    if "title" in names:
        title = root.find("title")
        found["title"] = title.text(" ") if title else ""
    if "lang" in names:
        html = root.find("html")
        found["lang"] = (html.attrs.get("lang") or None) if html else None
    if "selector" in names or "main" in names:
        found["selector"], found["main"] = main_content(root)
    rest = {
        "text": lambda: normalised_text(root), "description": lambda: meta(root, "description"), "keywords": lambda: meta(root, "keywords"), "breadcrumbs": lambda: breadcrumbs(root),
        "section_headers": lambda: section_headers(root), "permissions": lambda: permissions(root), "links": lambda: links(root, url),
    }
    return tuple(found[n] if n in found else rest[n]() for n in names)


def page_documents(pages: DataFrame, columns: tuple[str, ...] | None = None, whole: bool = False) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, title, text (normalised), selector and main (main content), lang,
    description, keywords, breadcrumbs, section_headers, permissions, links; or page_id, url and those of them that columns names.
    A null page is an empty one: empty texts and lists, null metadata. whole: as parse() has it."""
    ship(pages.sparkSession)
    kinds = {pa.string(): "string"}
    wanted = [(n, t) for n, t in _COLUMNS if columns is None or n in columns]
    names = tuple(n for n, _ in wanted)
    schema = ", ".join(f"{n} {kinds.get(t, 'array<string>')}" for n, t in wanted)

    def run(batches):
        for batch in pieces(batches):
            rows = [_page(parse(text or "", whole), url or "", names) for url, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), wanted, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["page_id", "url", *names])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, {schema}")
