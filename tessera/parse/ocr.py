"""Items of recognised pages as HTML, with an account of each item."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.parse.html import Node, tree

#: Kinds that aren't shown, kinds that are plain text, elements that tables keep, elements dropped with all they hold.
FURNITURE = frozenset({"page_number", "header", "footer"})
PLAIN = frozenset({"text", "page_footnote", "aside_text", "ref_text"})
KEPT = frozenset("table thead tbody tfoot tr td th caption p br b strong i em sub sup span code".split())
DROPPED = frozenset("script style iframe object embed img svg math".split())


class BadText(ValueError):
    """A text that isn't one, or has control characters."""


def _text(item: dict, name: str) -> str:
    value = item.get(name, "")
    if not isinstance(value, str) or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", value):
        raise BadText("invalid_text")
    return value


def _texts(item: dict, name: str) -> list[str]:
    value = item.get(name, [])
    return [t for v in (value if isinstance(value, list) else [value]) if (t := _text({"v": v}, "v")).strip()]


def inline(text: str) -> str:
    """Text with formulas between single dollars as ``math`` and backslashes before Markdown marks removed."""
    out, at = [], 0

    def words(part: str) -> str:
        part = re.sub(r"\\([*_`~$])", r"\1", part)
        return html.escape(re.sub(r"\A([ \t]{0,3})\\(#{1,6}|[-+])(?=[ \t])", r"\1\2", part))

    for m in re.finditer(r"(?<!\\)\$(?!\$)((?:\\.|[^$])+?)(?<!\\)\$", text, re.DOTALL):
        out += [words(text[at : m.start()]), f'<math alttext="{html.escape(m[1])}"></math>']
        at = m.end()
    return "".join([*out, words(text[at:])])


def _markup(node: Node, notes: list[str]) -> str:
    """The node's content with allowed elements only."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(inline(c))
        elif c.tag in DROPPED:
            notes.append("markup_removed")
        elif c.tag not in KEPT:
            notes.append("markup_removed")
            out.append(_markup(c, notes))
        else:
            spans = {k: v for k in ("rowspan", "colspan") if c.tag in ("td", "th") and (v := c.attrs.get(k, "")).isdecimal() and 1 <= int(v) <= 1000}
            if spans.keys() != c.attrs.keys():
                notes.append("markup_removed")
            inside = _markup(c, notes)
            out.append(f"<{c.tag}" + "".join(f' {k}="{v}"' for k, v in spans.items()) + (">" if c.tag == "br" else f">{inside}</{c.tag}>"))
    return "".join(out)


def _table(item: dict, image: str | None, notes: list[str]) -> list[tuple[str, str]]:
    root, captions = tree(_text(item, "table_body")), [inline(c) for c in _texts(item, "table_caption")]
    grids = [n for n in root.children if isinstance(n, Node) and n.tag == "table"]
    filled = lambda t: any(n.tag in ("td", "th") and n.text() for n in t.walk())
    if not any(map(filled, grids)):
        notes.append("no_table")
        words = root.text()
        return [("figure", image)] * bool(image) + [("p", inline(words))] * bool(words) + [("p", c) for c in captions]
    out: list[tuple[str, str]] = []
    for n in root.children:
        if isinstance(n, Node) and n.tag == "table":
            if not filled(n):
                notes.append("empty_table")
                continue
            head = f"<caption>{' '.join(captions)}</caption>" if captions else ""
            captions = []
            out.append(("table", head + _markup(n, notes)))
        elif body := _markup(Node("#root", children=[n]), notes).strip():
            out.append(("p", body))
    return out


def _code(item: dict, notes: list[str]) -> list[tuple[str, str]]:
    body = _text(item, "code_body")
    if not body.strip():
        notes.append("no_code")
        return []
    if item.get("sub_type") == "algorithm":
        return [("p", inline(body))]
    fence = re.fullmatch(r"```([\w.+-]*)\r?\n(.*)\r?\n```", body, re.DOTALL | re.ASCII)
    language, code = fence.groups() if fence else ("", body)
    return [("pre", f'<code class="language-{language}">{html.escape(code)}</code>')]


def item_parts(item: dict, images: dict[str, str]) -> tuple[list[tuple[str, str]], str, list[str]]:
    """(element, content) of the parts of an item, its status and notes; ``images`` has the target of each known path."""
    kind, notes = item.get("type"), []
    path = item.get("img_path") or ""
    image = f'<img src="{html.escape(images[path])}" alt="">' if path in images else None
    lines = lambda name: [("p", inline(t)) for t in _texts(item, name)]
    if kind in FURNITURE:
        return [], "excluded", []
    status = "included"
    if kind in PLAIN:
        level, text = item.get("text_level"), _text(item, "text")
        parts = [(f"h{level}" if type(level) is int and 1 <= level <= 6 else "p", inline(text))] * bool(text.strip())
    elif kind == "equation":
        tex = _text(item, "text").strip()
        tex = tex[2:-2].strip() if tex.startswith("$$") and tex.endswith("$$") else tex
        if tex:
            parts = [("math", tex)]
        else:
            notes.append("no_equation")
            parts = [("figure", image)] * bool(image)
    elif kind == "table":
        parts = _table(item, image, notes) + lines("table_footnote")
    elif kind in ("image", "chart"):
        captions = _texts(item, f"{kind}_caption")
        if image:
            parts = [("figure", image + (f"<figcaption>{' '.join(map(inline, captions))}</figcaption>" if captions else ""))]
        else:
            notes.append("no_image")
            parts = lines(f"{kind}_caption")
        parts += [("p", inline(_text(item, "content")))] * bool(item.get("content")) + lines(f"{kind}_footnote")
    elif kind == "list":
        parts = [("li", inline(t)) for t in _texts(item, "list_items")]
    elif kind == "code":
        parts = lines("code_caption") + _code(item, notes) + lines("code_footnote")
    else:
        text = _text(item, "text")
        parts = [("p", inline(text))] * bool(text.strip())
        return parts, "plain_fallback" if parts else "unavailable", ["unknown_kind"]
    if notes or not parts:
        status = "unavailable"
    return parts, status, notes


def item_html(item: dict, page: int, ordinal: int, images: dict[str, str]) -> tuple[str, str, list[str], list[str]]:
    """HTML of an item, its status, the ids of its elements and notes."""
    parts, status, notes = item_parts(item, images)
    out, ids = [], []
    for n, (tag, body) in enumerate(parts):
        ids.append(f"pdf-p{page}-b{ordinal}-n{n}")
        out.append(f'<math id="{ids[-1]}" display="block" alttext="{html.escape(body)}"></math>' if tag == "math" else f'<{tag} id="{ids[-1]}">{body}</{tag}>')
    if item.get("type") == "list":
        return f"<ul>{''.join(out)}</ul>", status, ids, notes
    return "\n".join(out), status, ids, list(dict.fromkeys(notes))


def render_items(items: DataFrame) -> DataFrame:
    """doc_id, ordinal, page, kind, status, source_ids, notes, html of items (doc_id, ordinal, page, item, images).

    ``item`` is a JSON object, ``images`` a map of image paths to targets. Pages count from 1. An item that isn't an
    object or has no valid text is a row with the status invalid and a note.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, ordinal, page, text, images in batch.itertuples(index=False):
                kind = None
                try:
                    item = json.loads(text)
                    if not isinstance(item, dict):
                        raise BadText("no_object")
                    kind = item.get("type") if isinstance(item.get("type"), str) else None
                    body, status, ids, notes = item_html(item, page, ordinal, dict(images or {}))
                    out.append((doc_id, ordinal, page, kind, status, ids, notes, body))
                except (ValueError, TypeError, RecursionError) as e:
                    out.append((doc_id, ordinal, page, kind, "invalid", [], [str(e) if isinstance(e, BadText) else "no_object"], ""))
            yield pd.DataFrame(out, columns=["doc_id", "ordinal", "page", "kind", "status", "source_ids", "notes", "html"])

    schema = "doc_id long, ordinal long, page long, kind string, status string, source_ids array<string>, notes array<string>, html string"
    return items.select("doc_id", "ordinal", "page", "item", "images").mapInPandas(run, schema)


def assembled(entries: DataFrame) -> DataFrame:
    """doc_id, html and entries: the source of each document of rendered items, in order.

    A document's items are gathered in one row, as they are one file.
    """
    from pyspark.sql import functions as F

    shown = F.struct("ordinal", "html")
    rows = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("html") != "", shown))).alias("x"), F.count(F.lit(1)).alias("entries"))
    body = F.array_join(F.transform("x", lambda v: v["html"]), "\n")
    return rows.select("doc_id", F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body>\n'), body, F.lit("\n</body></html>\n")).alias("html"), "entries")
