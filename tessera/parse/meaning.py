"""What the marks of rendered papers mean: roles of headings, numbered equations, captions, figure panels, drawings, media that no block holds."""

from __future__ import annotations

import re

from tessera.functions.arrow import normalize_tex_text
from tessera.parse.html import HEADINGS, Node, tree

#: Classes of metadata parts and of their titles; (part, title, role) of headings that stand for a part; equation numbers; flex cells.
CLASSIFICATIONS = frozenset({"ltx_classification", "ltx_keywords"})
CLASSIFICATION_TITLES = frozenset({"ltx_title_classification", "ltx_title_keywords"})
PARTS = (("ltx_abstract", "ltx_title_abstract", "abstract"), ("ltx_acknowledgements", "ltx_title_acknowledgements", "acknowledgements"))
CELL, BREAK, FLEX = "ltx_flex_cell", "ltx_flex_break", "ltx_flex_figure"
SIZES = frozenset({"ltx_flex_size_1", "ltx_flex_size_2", "ltx_flex_size_3"})
CENTRED = frozenset({"ltx_centering", "ltx_align_center"})
MEDIA = frozenset({"img", "object", "svg", "video"})
#: Elements and attributes that a standalone drawing must not have.
UNSAFE = frozenset("script iframe object embed link meta form input button select textarea animate animatemotion animatetransform set discard foreignobject".split())


class Unclear(ValueError):
    """The marks allow more than one reading; the message is the code."""


def classes(node: Node) -> frozenset[str]:
    return frozenset(node.attrs.get("class", "").lower().split())


def paths(root: Node, above: tuple[Node, ...] = ()):
    """(node, ancestors from the outermost) in document order."""
    for c in root.children:
        if isinstance(c, Node):
            yield c, above
            yield from paths(c, (*above, c))


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def _titles_part(node: Node, above: tuple[Node, ...], part: str, title: str) -> bool:
    around = [a for a in above if part in classes(a)]
    if len(around) > 1:
        raise Unclear("nested_part")
    if not around:
        return title in classes(node)
    direct = elements(around[0])
    named = [n for n, up in paths(around[0]) if n.tag in HEADINGS and not any(part in classes(a) for a in up) and (title in classes(n) or any(n is c for c in direct))]
    if len(named) > 1:
        raise Unclear("several_titles")
    return len(named) == 1 and named[0] is node


def _level_above(node: Node, above: tuple[Node, ...]) -> int:
    """Level of the heading that stands in front in the nearest section that has one; 1 outside sections."""
    line = (*above, node)
    for depth in range(len(above) - 1, -1, -1):
        if line[depth].tag != "section":
            continue
        inside = elements(line[depth])
        front = inside[: next(i for i, c in enumerate(inside) if c is line[depth + 1])]
        levels = [HEADINGS[c.tag] for c in front if c.tag in HEADINGS]
        if len(levels) > 1:
            raise Unclear("several_parents")
        if levels:
            return levels[0]
        if depth != len(above) - 1:
            raise Unclear("no_parent")
    return 1


def heading_roles(text: str) -> list[tuple[int, str, int | None, str | None, str | None]]:
    """(ordinal, title, level, role, problem) of headings; a heading that stands for a part is one level below its section's.

    A heading of unclear marks has no level and role, but a problem.
    """
    out = []
    for n, above in paths(tree(text)):
        if n.tag not in HEADINGS:
            continue
        try:
            roles = ["classification"] if CLASSIFICATION_TITLES & classes(n) or any(CLASSIFICATIONS & classes(a) for a in above) else []
            roles += [role for part, title, role in PARTS if _titles_part(n, above, part, title)]
            if len(roles) > 1:
                raise Unclear("conflicting_roles")
            role, level = (roles or [None])[0], HEADINGS[n.tag]
            if role in ("abstract", "acknowledgements"):
                level = _level_above(n, above) + 1
                if level > 6:
                    raise Unclear("too_deep")
                if role == "abstract" and level != 2:
                    raise Unclear("abstract_not_in_front")
            out.append((len(out), n.text(), level, role, None))
        except Unclear as e:
            out.append((len(out), n.text(), None, None, str(e)))
    return out


def _formula(n: Node) -> str:
    note = next((d for d in n.walk() if d.tag == "annotation" and "tex" in d.attrs.get("encoding", "").lower()), None)
    return normalize_tex_text(n.attrs.get("alttext") or n.attrs.get("alt") or (note.text() if note else "") or n.text())


def _label(n: Node) -> str:
    value = n.text()
    inner = re.fullmatch(r"\(\s*([^()]+?)\s*\)", value)
    return inner[1] if inner else value


def _is_number(n: Node) -> bool:
    return any(re.fullmatch(r"ltx_tag(_.*)?|tag|eqno|equation-number", c) for c in classes(n))


def equation_units(table: Node) -> list[tuple[str, str]]:
    """(tex, label) of the equations of a table: a row with one number takes the formulas of the rows nearest to it, the upper one of two.

    Without numbered rows a number of the whole table takes all formulas; without any each row is an equation.
    """
    formulas: list[tuple[int, Node]] = []  # (row, formula), -1 outside rows
    numbers: dict[int, list[str]] = {}
    rows: list[Node] = []
    for n, above in paths(table):
        if n.tag == "tr" and not any(a.tag == "table" for a in above):
            rows.append(n)
        row = next((a for a in reversed(above) if a.tag == "tr"), None)
        at = next((i for i, r in enumerate(rows) if r is row), -1)
        if n.tag == "math" and not any(a.tag == "math" for a in above):
            formulas.append((at, n))
        elif _is_number(n) and not any(_is_number(a) for a in above):
            numbers.setdefault(at, []).append(_label(n))
    numbered = [i for i, labels in sorted(numbers.items()) if i >= 0 and len(labels) == 1]
    every = [x for labels in numbers.values() for x in labels]
    groups: dict[tuple, list[Node]] = {}
    for k, (at, n) in enumerate(formulas):
        if len(numbered) == 1:
            key = ("row", numbered[0])
        elif numbered and at >= 0 and (at in numbered or at not in numbers):
            key = ("row", min(numbered, key=lambda i, at=at: (abs(i - at), i)))
        elif not numbered and len(every) == 1:
            key = ("table", every[0])
        elif not every and at >= 0:
            key = ("plain", at)
        else:
            key = ("single", k)
        groups.setdefault(key, []).append(n)
    label = {"row": lambda v: numbers[v][0], "table": lambda v: v, "plain": lambda v: "", "single": lambda v: ""}
    found = ((normalize_tex_text(" ".join(map(_formula, ns))), label[kind](v)) for (kind, v), ns in groups.items())
    return [(tex, name) for tex, name in found if tex]


def equations(text: str) -> list[tuple[int, str, str]]:
    """(ordinal, tex, label) of the equations of tables that hold formulas, outer tables only."""
    units = [u for n, above in paths(tree(text)) if n.tag == "table" and not any(a.tag == "table" for a in above) and n.first("math") for u in equation_units(n)]
    return [(i, *u) for i, u in enumerate(units)]


def _alignment(caption: Node) -> str | None:
    styles = [v.partition(":") for v in caption.attrs.get("style", "").split(";")]
    stated = [re.sub(r"\s*!important\s*$", "", v.strip(), flags=re.I).lower() for k, _, v in styles if k.strip().lower() == "text-align"]
    known = [v for v in stated if v in ("start", "center", "end")]
    evidence = set(known) | ({"center"} if CENTRED & classes(caption) else set())
    other = len(known) < len(stated)
    if len(evidence) > 1 or (other and evidence):
        raise Unclear("conflicting_alignment")
    return evidence.pop() if evidence else None


def captions(text: str) -> list[tuple[int, str, str, str | None, str | None, str | None]]:
    """(ordinal, kind, text, placement, alignment, problem) of captions that a figure or table owns.

    Placement is before_content, after_content or embedded (a table's own caption element); alignment is what style and
    class agree on. What is unclear has neither, but a problem.
    """
    out = []
    for owner, _ in paths(tree(text)):
        if owner.tag not in ("figure", "table"):
            continue
        own = [(n, up) for n, up in paths(owner) if n.tag == ("figcaption" if owner.tag == "figure" else "caption") and not any(a.tag == owner.tag for a in up)]
        top = elements(owner)
        for n, up in own:
            try:
                if len(own) > 1:
                    raise Unclear("several_captions")
                if n.tag == "caption" and not up:
                    placement = "embedded"
                else:
                    here = next(i for i, c in enumerate(top) if c is (up[0] if up else n))
                    content = [i for i, c in enumerate(top) if i != here and any(d.tag in MEDIA | {"table", "math", "tr", "pre"} for d in c.walk())]
                    if not content:
                        raise Unclear("no_content")
                    placement = "before_content" if here < content[0] else "after_content" if here > content[-1] else None
                    if placement is None:
                        raise Unclear("between_content")
                out.append((len(out), owner.tag, n.text(), placement, _alignment(n), None))
            except Unclear as e:
                out.append((len(out), owner.tag, n.text(), None, None, str(e)))
    return out


def _target(n: Node) -> str:
    return n.attrs.get("src") or n.attrs.get("data") or f"inline:{n.tag}"


def _pixels(value: str | None) -> int | None:
    m = re.fullmatch(r"\s*([1-9]\d{0,5})(?:px)?\s*", value or "")
    return int(m[1]) if m else None


def outer_media(node: Node) -> list[Node]:
    return [n for n, above in paths(node) if n.tag in MEDIA and not any(a.tag in MEDIA for a in above)]


def _flex_rows(root: Node) -> list[list[Node]]:
    rows: list[list[Node]] = [[]]
    for c in elements(root):
        names = classes(c)
        if any(x.startswith("ltx_flex_") and x not in SIZES | {CELL, BREAK} for x in names):
            raise Unclear("unknown_flex_class")
        if BREAK in names:
            if CELL in names or SIZES & names or elements(c) or not rows[-1]:
                raise Unclear("bad_break")
            rows.append([])
            continue
        if CELL not in names or len(SIZES & names) != 1:
            raise Unclear("bad_cell")
        held = outer_media(c)
        if len(held) != 1:
            raise Unclear("cell_without_one_graphic")
        rows[-1].append(held[0])
    if not rows[-1]:
        raise Unclear("bad_break")
    return rows


def panels(text: str) -> list[tuple]:
    """(figure, panel, layout, row, col, target, width, height, ratio, problem) of the graphics of outer figures.

    Layout is single, flex (rows of cells, cut by breaks) or neutral, which has no rows; flex marks that are unclear are
    a problem and the layout neutral. The ratio is width:height in lowest terms.
    """
    from math import gcd

    out = []
    outer = [n for n, above in paths(tree(text)) if n.tag == "figure" and not any(a.tag == "figure" for a in above)]
    for k, figure in enumerate(outer):
        media, place, problem = outer_media(figure), {}, None
        flex = [n for n in figure.walk() if FLEX in classes(n)]
        if len(media) == 1 and not flex:
            layout = "single"
        else:
            layout = "flex" if len(flex) == 1 else "neutral"
            try:
                if len(flex) > 1:
                    raise Unclear("several_flex_roots")
                for r, cells in enumerate(_flex_rows(flex[0]) if flex else []):
                    place |= {id(n): (r, c) for c, n in enumerate(cells)}
                if flex and len(place) != len(media):
                    raise Unclear("graphic_outside_cells")
            except Unclear as e:
                layout, place, problem = "neutral", {}, str(e)
        for i, n in enumerate(media):
            w, h = (_pixels(n.attrs.get(a)) for a in ("width", "height"))
            ratio = f"{w // gcd(w, h)}:{h // gcd(w, h)}" if w and h else None
            out.append((k, i, layout, *place.get(id(n), (None, None)), _target(n), w, h, ratio, problem))
    return out


def loose_media(text: str) -> list[tuple[int, str, str, str]]:
    """(ordinal, element, target, alt) of media that lie where blocks keep only text: headings, lists, table cells, definitions, code.

    They become figures of their own, in document order.
    """
    holds = frozenset(HEADINGS) | {"ul", "ol", "dl", "table", "pre"}
    found = [(n.tag, _target(n), n.attrs.get("alt", "")) for n, above in paths(tree(text)) if n.tag in MEDIA and any(a.tag in holds for a in above) and not any(a.tag in MEDIA | {"figure"} for a in above)]
    return [(i, *f) for i, f in enumerate(found)]


_TAG = re.compile(r"""<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([A-Za-z][\w:.-]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)>""", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)""")


def drawing_slices(text: str) -> list[tuple[int, int]]:
    """Start and end of each ``svg`` element in the text, inner ones too, by start; none at all if one isn't closed."""
    open_, out = [], []
    for m in _TAG.finditer(text):
        if (m[3] or "").lower() != "svg":
            continue
        if m[2]:
            if not open_:
                return []
            out.append((open_.pop(), m.end()))
        elif m[5]:
            out.append((m.start(), m.end()))
        else:
            open_.append(m.start())
    return [] if open_ else sorted(out)


def standalone(svg: str) -> str:
    """The drawing without scripts, outside styles, events, script addresses and unsafe elements, with its name space."""
    out, skip, last = [], [], 0
    for m in _TAG.finditer(svg):
        out.append("" if skip else svg[last : m.start()])
        last = m.end()
        name = (m[3] or "").lower()
        if m[1] or not name:  # whole scripts and styles, comments
            if m[1] and m[1].lower() == "style" and not skip and not re.search(r"@import|url\s*\(|expression|javascript:|</|\\", m[0][m[0].index(">") : m[0].rindex("</")], re.I):
                out.append(m[0])
        elif name in UNSAFE:
            if m[2]:
                if skip and skip[-1] == name:
                    skip.pop()
            elif not m[5]:
                skip.append(name)
        elif not skip:
            kept = [(k, v) for k, v in _ATTRIBUTE.findall(m[4]) if not k.lower().startswith("on") and not re.match(r"\s*javascript\s*:", v.strip("\"'"), re.I)]
            if name == "svg" and not m[2] and not any(out) and all(k.lower() != "xmlns" for k, _ in kept):
                kept.append(("xmlns", '"http://www.w3.org/2000/svg"'))
            out.append(f"<{m[2]}{m[3]}" + "".join(f" {k}={v}" for k, v in kept) + f"{m[5]}>")
    return "".join(out)


def drawings(text: str) -> list[tuple[int, int, int, str]]:
    """(ordinal, start, end, standalone source) of the outermost drawings."""
    out, reach = [], 0
    for a, b in drawing_slices(text):
        if a >= reach:
            out.append((len(out), a, b, standalone(text[a:b])))
            reach = b
    return out
