"""Rich blocks of HTML and TeX: headings with roles, paragraphs with inline segments, lists, code, equations, tables, figures, notes, authors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.parse import tex as plain_tex
from tessera.parse.html import HEADINGS, HIDDEN, Node, roots, table_grid, tree
from tessera.parse.spans import ENVIRONMENTS, Unclosed


@dataclass
class Block:
    kind: str
    text: str
    level: int | None = None
    role: str | None = None
    caption: str | None = None
    placement: str | None = None
    parts: list = field(default_factory=list)


#: Headings that stand for a part of their own.
ROLES = {"abstract": "abstract", "acknowledgements": "acknowledgements", "acknowledgments": "acknowledgements", "references": "references", "bibliography": "references", "keywords": "classification", "subject classification": "classification"}
_BLOCKS = frozenset("p div section article header footer main aside nav blockquote figure table pre ul ol dl math h1 h2 h3 h4 h5 h6 center details summary".split())


def role_of(title: str) -> str | None:
    return ROLES.get(re.sub(r"[^a-z ]", "", title.lower()).strip())


def segments(node: Node) -> list[tuple[str, str, str]]:
    """(kind, text, target) of mixed content: text, link, math, mark, note and media, neighbours of one kind joined."""
    out: list[tuple[str, str, str]] = []

    def add(kind: str, text: str, target: str = "") -> None:
        if out and out[-1][0] == kind == "text":
            out[-1] = (kind, out[-1][1] + text, "")
        elif text or target:
            out.append((kind, text, target))

    def look(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                add("text", re.sub(r"\s+", " ", c))
            elif c.tag in HIDDEN:
                continue
            elif c.tag == "math":
                add("math", c.attrs.get("alttext") or c.text())
            elif c.tag in ("img", "object", "video", "svg"):
                add("media", c.attrs.get("alt", ""), c.attrs.get("src") or c.attrs.get("data") or f"inline:{c.tag}")
            elif c.tag == "a" and c.attrs.get("href"):
                kind = "note" if c.attrs["href"].startswith("#") and (c.attrs.get("role") == "doc-noteref" or c.text().strip("[]()*†‡").isdigit() or not c.text().strip("*†‡[]")) else "link"
                add(kind, c.text(), c.attrs["href"])
            elif c.tag in ("b", "strong", "i", "em", "sup", "sub", "code", "u", "s"):
                add("mark:" + {"b": "strong", "i": "em"}.get(c.tag, c.tag), c.text())
            else:
                look(c)

    look(node)
    return out


def _caption(node: Node, tags: tuple[str, ...]) -> tuple[str | None, str | None]:
    """Text and placement of the only caption inside a figure or table; several give none."""
    content = [c for c in node.children if isinstance(c, Node)]
    found = [(i, c) for i, c in enumerate(content) if c.tag in tags]
    if len(found) != 1:
        return None, None
    i = found[0][0]
    return found[0][1].text() or None, "embedded" if len(content) == 1 else "before" if i == 0 else "after" if i == len(content) - 1 else "embedded"


def html_blocks(text: str) -> list[Block]:
    """The blocks of a page's articles, in order."""
    out: list[Block] = []

    def paragraph(nodes: list) -> None:
        n = Node("p", children=nodes)
        if n.text() or n.first("img") or n.first("math"):
            only = [c for c in nodes if isinstance(c, Node) or c.strip()]
            if len(only) == 1 and isinstance(only[0], Node) and only[0].tag == "math":
                out.append(Block("equation", only[0].attrs.get("alttext") or only[0].text()))
            elif len(only) == 1 and isinstance(only[0], Node) and only[0].tag in ("img", "svg", "object"):
                out.append(Block("figure", only[0].attrs.get("alt", ""), parts=[only[0].attrs.get("src") or only[0].attrs.get("data") or f"inline:{only[0].tag}"]))
            else:
                out.append(Block("paragraph", n.text(), parts=segments(n)))

    def look(n: Node) -> None:
        loose: list = []
        for c in n.children:
            if isinstance(c, str) or (c.tag not in _BLOCKS and c.tag not in HIDDEN and not any(d.tag in _BLOCKS - {"math"} for d in c.walk())):
                if isinstance(c, Node) and c.tag == "math" and c.attrs.get("display") == "block":
                    pass
                else:
                    loose.append(c)
                    continue
            if loose:
                paragraph(loose)
                loose = []
            if isinstance(c, str) or c.tag in HIDDEN:
                continue
            if c.tag in HEADINGS:
                out.append(Block("heading", c.text(), HEADINGS[c.tag], role_of(c.text())))
            elif c.tag == "math":
                out.append(Block("equation", c.attrs.get("alttext") or c.text()))
            elif c.tag == "pre":
                out.append(Block("code", "".join(x for d in c.walk() for x in d.children if isinstance(x, str)).strip("\n")))
            elif c.tag in ("ul", "ol"):
                items = [i.text() for i in c.children if isinstance(i, Node) and i.tag == "li"]
                out.append(Block("list", "\n".join(items), role="ordered" if c.tag == "ol" else "bullet", parts=items))
            elif c.tag == "table":
                grid = table_grid(c)
                caption, placement = _caption(c, ("caption",))
                rows = [[x[5] for x in grid if x[0] == r] for r in range(max((x[0] for x in grid), default=-1) + 1)]
                out.append(Block("table", "\n".join("\t".join(r) for r in rows), caption=caption, placement=placement, parts=grid))
            elif c.tag == "figure":
                caption, placement = _caption(c, ("figcaption",))
                inner = c.first("table")
                media = [m.attrs.get("src") or m.attrs.get("data") or f"inline:{m.tag}" for m in c.walk() if m.tag in ("img", "object", "svg", "video")]
                if inner and not media:
                    out.append(Block("table", inner.text(), caption=caption, placement=placement, parts=table_grid(inner)))
                else:
                    out.append(Block("figure", caption or "", role="panels" if len(media) > 1 else "single", caption=caption, placement=placement, parts=media))
            elif c.tag == "p" and not any(d.tag in _BLOCKS for d in c.walk() if d is not c and d.tag != "math"):
                paragraph(c.children)
            else:
                look(c)
        if loose:
            paragraph(loose)

    for r in roots(tree(text)):
        look(r)
    return out


def notes(text: str) -> list[tuple[str, str, str]]:
    """(anchor id, marker, body) of notes that a link in the text points to, in the order of the links."""
    root = tree(text)
    ids = {n.attrs["id"]: n for n in root.walk() if n.attrs.get("id")}
    out, seen = [], set()
    for n in root.walk():
        target = n.attrs.get("href", "")[1:]
        if n.tag == "a" and n.attrs.get("href", "").startswith("#") and target in ids and target not in seen:
            body = ids[target]
            if body.tag in ("li", "aside", "p", "div") and ("note" in target.lower() or "fn" in target.lower() or "note" in body.attrs.get("class", "").lower()):
                seen.add(target)
                out.append((target, n.text(), body.text()))
    return out


def authors(text: str) -> list[tuple[int, str, str | None, list[str]]]:
    """(ordinal, name, ORCID, affiliations) from citation metadata, else from elements of the class author."""
    root = tree(text)
    out: list[tuple[int, str, str | None, list[str]]] = []
    for n in root.walk():
        key = n.attrs.get("name", "").lower() if n.tag == "meta" else ""
        value = n.attrs.get("content", "").strip()
        if key == "citation_author" and value:
            out.append((len(out), value, None, []))
        elif key == "citation_author_institution" and out and value:
            out[-1][3].append(value)
        elif key == "citation_author_orcid" and out and (m := re.search(r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]", value)):
            out[-1] = (*out[-1][:2], m[0], out[-1][3])
    if not out:
        for n in root.walk():
            if "author" in n.attrs.get("class", "").lower().split() and n.text():
                links = " ".join(d.attrs.get("href", "") for d in n.walk())
                m = re.search(r"orcid\.org/(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", links)
                out.append((len(out), n.text(), m[1] if m else None, []))
    return out


_BEGIN = re.compile(r"\\begin\{([A-Za-z]+\*?)\}")


def tex_blocks(text: str) -> list[Block]:
    """Headings, paragraphs, lists, code, equations, tables and figures of a TeX text, in order; raises Unclosed."""
    clean = plain_tex.masked(text)
    begin = re.search(r"\\begin\{document\}", clean)
    at = begin.end() if begin else 0
    stop = clean.find("\\end{document}", at)
    stop = len(clean) if stop < 0 else stop
    out: list[Block] = []
    loose: list[str] = []

    def flush() -> None:
        for part in re.split(r"\n[ \t]*\n", "".join(loose)):
            # formulas stay as they are; other commands go
            kept = re.split(r"(\$[^$]+\$|\\\(.*?\\\))", part)
            line = " ".join(" ".join(k if i % 2 else plain_tex.plain(k) for i, k in enumerate(kept)).split())
            if line:
                out.append(Block("paragraph", line))
        loose.clear()

    def inside(name: str, start: int) -> tuple[str, int]:
        depth, i = 1, start
        while depth:
            a, b = clean.find(f"\\begin{{{name}}}", i), clean.find(f"\\end{{{name}}}", i)
            if b < 0:
                raise Unclosed(f"unclosed environment {name}")
            depth, i = (depth + 1, a + 1) if 0 <= a < b else (depth - 1, b + 1)
        return clean[start : i - 1], i - 1 + len(f"\\end{{{name}}}")

    def argument(body: str, command: str) -> str | None:
        m = re.search(rf"\\{command}\*?(?:\[[^\]]*\])?\s*\{{", body)
        end = plain_tex.balanced(body, m.end() - 1) if m else -1
        return plain_tex.plain(body[m.end() : end - 1]) if m and end > 0 else None

    while at < stop:
        nexts = [m for m in (_BEGIN.search(clean, at, stop), plain_tex._HEADING.search(clean, at, stop), re.compile(r"\$\$|\\\[").search(clean, at, stop)) if m]
        if not nexts:
            loose.append(clean[at:stop])
            break
        m = min(nexts, key=lambda x: x.start())
        loose.append(clean[at : m.start()])
        if m[0] in ("$$", "\\["):
            flush()
            end = clean.find("$$" if m[0] == "$$" else "\\]", m.end())
            if end < 0:
                raise Unclosed(f"unclosed {m[0]}")
            out.append(Block("equation", clean[m.end() : end].strip()))
            at = end + 2
        elif m.re is plain_tex._HEADING:
            flush()
            end = plain_tex.balanced(clean, m.end() - 1)
            if end < 0:
                raise Unclosed("unclosed heading")
            title = plain_tex.plain(clean[m.end() : end - 1])
            out.append(Block("heading", title, plain_tex.LEVELS[m[1]], role_of(title)))
            at = end
        else:
            flush()
            name = m[1].rstrip("*")
            body, at = inside(m[1], m.end())
            if name in ENVIRONMENTS:
                out.append(Block("equation", body.strip()))
            elif name in ("itemize", "enumerate", "description"):
                items = [plain_tex.plain(re.sub(r"^\s*\[[^\]]*\]", "", x)) for x in re.split(r"\\item\b", body)[1:]]
                out.append(Block("list", "\n".join(items), role="ordered" if name == "enumerate" else "bullet", parts=items))
            elif name in ("figure", "wrapfigure"):
                files = re.findall(r"\\includegraphics\*?(?:\[[^\]]*\])?\{([^}]*)\}", body)
                caption = argument(body, "caption")
                out.append(Block("figure", caption or "", role="panels" if len(files) > 1 else "single", caption=caption, parts=files))
            elif name in ("table", "tabular", "longtable"):
                grid = re.search(r"\\begin\{tabular\*?\}(?:\{[^}]*\})+(.*?)\\end\{tabular\*?\}", body, re.DOTALL)
                cells = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", grid[1] if grid else re.sub(r"^\{[^}]*\}", "", body))
                rows = [[plain_tex.plain(c) for c in r.split("&")] for r in cells.split("\\\\") if r.strip()]
                out.append(Block("table", "\n".join("\t".join(r) for r in rows), caption=argument(body, "caption"), parts=rows))
            elif name == "abstract":
                out.append(Block("heading", "Abstract", 1, "abstract"))
                loose.append(body)
                flush()
            else:
                loose.append(body)
                flush()
    flush()
    verbatim = [(x.start(), re.sub(r"^\\begin\{[^}]*\}(?:\[[^\]]*\])?|\\end\{[^}]*\}$", "", x[0]).strip("\n")) for x in plain_tex._VERBATIM.finditer(text) if x[1] != "comment"]
    return out + [Block("code", body) for _, body in verbatim]
