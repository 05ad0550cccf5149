"""HTML: a small tree, and sections, formulas, terms, dependencies, lists and tables read from it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

from tessera.parse.markdown import Section
from tessera.parse.spans import Span

#: Elements without content, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template noscript head".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An element of the first kind ends open ones of the second kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Limits: dependencies of a document, a cell's span, and the points of a table.
MOST_DEPENDENCIES, MOST_SPAN, MOST_POINTS = 256, 4096, 65_536


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    line: int = 1

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def text(self, between: str = " ") -> str:
        """Visible text, white space collapsed."""
        parts: list[str] = []

        def add(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    parts.append(c)
                elif c.tag not in HIDDEN:
                    parts.append(between if c.tag in CLOSES_P or c.tag in ("br", "li", "td", "th", "tr") else "")
                    add(c)
                    parts.append(between if c.tag in CLOSES_P or c.tag in ("li", "td", "th", "tr") else "")

        add(self)
        return " ".join("".join(parts).split())

    def first(self, tag: str):
        return next((n for n in self.walk() if n.tag == tag), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close_until(self, tags: set[str], scope: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in scope:
                return
            if self.open[k].tag in tags:
                del self.open[k:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_until({"p"}, {"table", "button"})
        if tag in CLOSES:
            self._close_until(CLOSES[tag], SCOPES.get(tag, set()))
        node = Node(tag, {k: v or "" for k, v in attrs}, line=self.getpos()[0])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(text: str) -> Node:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def roots(root: Node) -> list[Node]:
    """Articles that lie in no other article, else the body, else all."""
    out: list[Node] = []

    def look(n: Node) -> None:
        for c in n.children:
            if isinstance(c, Node):
                out.append(c) if c.tag == "article" else look(c)

    look(root)
    return out or [root.first("body") or root]


def sections(text: str) -> list[Section]:
    """A section for each heading: the texts that follow until a heading of the same or a higher level."""
    flow: list[tuple[int | None, str, int]] = []

    def look(n: Node) -> None:
        if n.tag in HIDDEN:
            return
        if n.tag in HEADINGS:
            flow.append((HEADINGS[n.tag], n.text(), n.line))
            return
        inner = any(d.tag in HEADINGS for d in n.walk() if d is not n)
        if inner:
            for c in n.children:
                if isinstance(c, Node):
                    look(c)
                elif c.strip():
                    flow.append((None, " ".join(c.split()), n.line))
        elif n.text():
            flow.append((None, n.text(), n.line))

    for r in roots(tree(text)):
        for c in r.children:
            if isinstance(c, Node):
                look(c)
            elif c.strip():
                flow.append((None, " ".join(c.split()), r.line))
    out: list[Section] = []
    heads = [i for i, f in enumerate(flow) if f[0] is not None]
    if not heads:
        body = "\n".join(f[1] for f in flow)
        return [Section("Document", 1, 0, 1, body)] if body else []
    for i in heads:
        stop = next((j for j in heads if j > i and flow[j][0] <= flow[i][0]), len(flow))
        out.append(Section(flow[i][1], flow[i][0], len(out), flow[i][2], "\n".join(f[1] for f in flow[i + 1 : stop])))
    return out


def spans(text: str) -> list[Span]:
    """``math`` elements, with the TeX annotation or the alternative text; start and end are lines."""
    out = []
    for n in tree(text).walk():
        if n.tag == "math":
            note = next((d for d in n.walk() if d.tag == "annotation" and "tex" in d.attrs.get("encoding", "").lower()), None)
            tex = note.text() if note else n.attrs.get("alttext") or n.text()
            out.append(Span("display" if n.attrs.get("display") == "block" else "inline", n.line, n.line, tex, n.attrs.get("id") or None))
    return out


def terms(text: str) -> list[str]:
    """Terms of keyword metadata, by commas and semicolons, and of elements of the class keyword."""
    out: list[str] = []
    for n in tree(text).walk():
        if n.tag == "meta" and n.attrs.get("name", "").lower() in ("keywords", "citation_keywords", "dc.subject"):
            out += re.split("[,;]", n.attrs.get("content", ""))
        elif {"keyword", "kwd"} & set(n.attrs.get("class", "").lower().split()):
            out.append(n.text())
    return list(dict.fromkeys(t.strip() for t in out if t.strip().strip("-–— ")))


def dependencies(text: str, base: str = "") -> list[tuple[int, str, str, str]]:
    """(ordinal, element, attribute, address) of images, sources and objects; the first of each address, at most 256."""
    root = tree(text)
    b = root.first("base")
    base = urljoin(base, b.attrs.get("href", "")) if b else base
    found: dict[str, tuple[str, str]] = {}
    for n in root.walk():
        for tag, attr in (("object", "data"), ("img", "src"), ("source", "src"), ("img", "srcset"), ("source", "srcset")):
            if n.tag == tag and n.attrs.get(attr):
                for part in n.attrs[attr].split(",") if attr == "srcset" else [n.attrs[attr]]:
                    address = part.split()[0] if part.split() else ""
                    if address and not address.startswith("data:"):
                        found.setdefault(urljoin(base, address), (tag, attr))
    return [(i, *where, address) for i, (address, where) in enumerate(list(found.items())[:MOST_DEPENDENCIES])]


def list_items(text: str) -> list[tuple[str, str, str]]:
    """(path of ordinals, kind, own text) of list items, outer ones first."""
    out: list[tuple[str, str, str]] = []

    def look(n: Node, path: str) -> None:
        k = 0
        for c in n.children:
            if not isinstance(c, Node) or c.tag in HIDDEN:
                continue
            if c.tag == "li" and n.tag in ("ul", "ol"):
                k += 1
                own = Node("li", children=[d for d in c.children if not (isinstance(d, Node) and d.tag in ("ul", "ol"))])
                here = f"{path}.{k}" if path else str(k)
                out.append((here, "ordered" if n.tag == "ol" else "bullet", own.text()))
                look(c, here)
            else:
                look(c, path)

    look(tree(text), "")
    return out


def table_grid(table: Node) -> list[tuple[int, int, int, int, bool, str]]:
    """(row, column, rows, columns, header, text) of cells, spans resolved against cells from above; raises over the limits."""
    taken: set[tuple[int, int]] = set()
    out = []
    rows = [n for n in table.walk() if n.tag == "tr"]
    for r, tr in enumerate(rows):
        c = 0
        for cell in (n for n in tr.children if isinstance(n, Node) and n.tag in ("td", "th")):
            while (r, c) in taken:
                c += 1
            span = [int(v) if (v := cell.attrs.get(k, "1")).isdigit() else 1 for k in ("rowspan", "colspan")]
            h, w = (min(span[0], len(rows) - r) or len(rows) - r), span[1] or 1
            if max(span) > MOST_SPAN or len(taken) + h * w > MOST_POINTS:
                raise ValueError("table_too_large")
            taken.update((r + i, c + j) for i in range(h) for j in range(w))
            out.append((r, c, h, w, cell.tag == "th", cell.text()))
            c += w
    return out


def tables(text: str) -> list[list[tuple[int, int, int, int, bool, str]]]:
    return [table_grid(n) for n in tree(text).walk() if n.tag == "table"]
