"""Targets of embedded resources in a page, and their replacement by local paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape

import pandas as pd
from pyspark.sql import DataFrame

#: Elements that embed something, and their attributes that name it, in order.
TARGETS = {"object": ("data",), "img": ("src", "srcset"), "source": ("src", "srcset")}
_SKIP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"""<(object|img|source)\b((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


class Mismatch(ValueError):
    """The page isn't the one that its records were made of."""


def embedded(text: str) -> list[tuple[str, str, str, int, int]]:
    """(element, attribute, target, start and end of the value with its quotes) in the order of the page, comments and scripts left out."""
    hidden = [m.span() for m in _SKIP.finditer(text)]
    out = []
    for tag in _TAG.finditer(text):
        if any(a <= tag.start() < b for a, b in hidden):
            continue
        found = {}
        for m in _ATTRIBUTE.finditer(text, *tag.span(2)):
            found.setdefault(m[1].lower(), m)
        for name in TARGETS[tag[1].lower()]:
            if m := found.get(name):
                value = m[2][1:-1] if m[2][0] in "\"'" else m[2]
                out.append((tag[1].lower(), name, unescape(value), *m.span(2)))
    return out


def rewritten(text: str, records: list[dict]) -> tuple[str, int]:
    """The page with the target of each record (ordinal, element, attribute, target, path) replaced by its path, and how many were; a null path stays."""
    places = embedded(text)
    if len(places) < len(records):
        raise Mismatch
    changes = []
    for r in records:
        element, attribute, target, a, b = places[r["ordinal"]] if 0 <= r["ordinal"] < len(places) else (None, None, None, 0, 0)
        if (element, attribute, target) != (r["element"], r["attribute"], r["target"]):
            raise Mismatch
        if r["path"] is not None and r["path"] != target:
            changes.append((a, b, f'"{escape(r["path"])}"'))
    for a, b, new in sorted(changes, reverse=True):
        text = text[:a] + new + text[b:]
    return text, len(changes)


def materialized(pages: DataFrame) -> DataFrame:
    """doc_id, text, rewrites and error of pages (doc_id, text, records); a page that its records don't fit has only the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, records in batch.itertuples(index=False):
                try:
                    rows.append((doc_id, *rewritten(text or "", list(records) if records is not None else []), None))
                except Mismatch:
                    rows.append((doc_id, None, None, "source_mismatch"))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "rewrites", "error"]).astype({"rewrites": "Int64"})

    return pages.select("doc_id", "text", "records").mapInPandas(run, "doc_id long, text string, rewrites long, error string")
