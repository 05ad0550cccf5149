"""Containers: outline trees, EPUB books, and byte streams of providers."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: Limits of a book: files, and bytes unpacked.
MOST_FILES, MOST_BYTES = 20_000, 500 << 20


def outline_rows(tree: list[dict], path: tuple[int, ...] = ()) -> Iterator[tuple[str, str, int, str | None, int | None, bool]]:
    """(key path, title, level, parent path, page, has children) of a nested outline, depth first."""
    for i, node in enumerate(tree):
        here = (*path, i)
        kids = node.get("kids") or []
        yield ".".join(map(str, here)), node.get("title") or "", len(here), ".".join(map(str, path)) or None, node.get("page"), bool(kids)
        yield from outline_rows(kids, here)


def outlines(documents: DataFrame) -> DataFrame:
    """Rows of outlines given as JSON (doc_id, outline: a list of nodes with title, page and kids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *r) for d, o in batch[["doc_id", "outline"]].itertuples(index=False) if o for r in outline_rows(json.loads(o))]
            yield pd.DataFrame(rows, columns=["doc_id", "path", "title", "level", "parent", "page", "has_children"]).astype({"page": "Int64"})

    return documents.select("doc_id", "outline").mapInPandas(run, "doc_id long, path string, title string, level int, parent string, page long, has_children boolean")


class BadBook(ValueError):
    """A book that breaks the format or a limit."""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def book_chapters(data: bytes) -> list[tuple[str, str]]:
    """(path, HTML without scripts, styles and templates) of an EPUB's readable documents in reading order."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        infos = z.infolist()
        if len(infos) > MOST_FILES or sum(i.file_size for i in infos) > MOST_BYTES:
            raise BadBook("too_large")
        for i in infos:
            clean = posixpath.normpath(i.filename)
            if clean.startswith(("/", "..")) or "\\" in i.filename:
                raise BadBook("unsafe_path")
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        root = ElementTree.fromstring(z.read(package))
        items = {e.attrib["id"]: e.attrib for e in root.iter() if _local(e.tag) == "item"}
        out = []
        for ref in (e.attrib["idref"] for e in root.iter() if _local(e.tag) == "itemref"):
            item = items[ref]
            if item.get("media-type") not in ("application/xhtml+xml", "text/html"):
                continue
            path = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(item["href"])))
            text = z.read(path).decode("utf-8", "replace")
            out.append((path, re.sub(r"(?is)<(script|style|template)\b.*?</\1\s*>", "", text)))
        return out
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration) as e:
        raise BadBook("invalid_book") from e


def books(files: DataFrame) -> DataFrame:
    """Chapters of books (doc_id, payload): doc_id, ordinal, path, html, error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for d, payload in batch[["doc_id", "payload"]].itertuples(index=False):
                try:
                    rows += [(d, i, p, t, None) for i, (p, t) in enumerate(book_chapters(bytes(payload)))]
                except BadBook as e:
                    rows.append((d, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "path", "html", "error"]).astype({"ordinal": "Int64"})

    return files.select("doc_id", "payload").mapInPandas(run, "doc_id long, ordinal long, path string, html string, error string")


#: Kinds of terminal events; a definitive failure outranks a transient one.
RANK = {"failed": 2, "interrupted": 1}


class Accumulator:
    """Collects a provider's bytes into JSON lines and keeps what decides the task."""

    def __init__(self):
        self.rest, self.lines, self.bad = b"", 0, 0
        self.failure: str | None = None
        self.texts: list[str] = []
        self.terminal: list[str] = []
        self.success = False

    def feed(self, chunk: bytes) -> None:
        *lines, self.rest = (self.rest + chunk).split(b"\n")
        for line in lines:
            self._line(line)

    def _line(self, line: bytes) -> None:
        if not line.strip():
            return
        try:
            event = json.loads(line)
            kind = event["type"]
        except (ValueError, TypeError, KeyError):
            self.bad += 1
            return
        self.lines += 1
        if kind == "text":
            self.texts.append(str(event.get("text", "")))
        elif kind == "result":
            self.terminal.append(str(event.get("text", "")))
        elif kind == "completed":
            self.success, self.failure = True, None
        elif kind in RANK and RANK[kind] >= RANK.get(self.failure or "", 0):
            self.success, self.failure = False, kind

    def close(self) -> tuple[str, str | None]:
        """(status, text): completed needs a success and exactly one terminal text."""
        self._line(self.rest)
        self.rest = b""
        if self.failure:
            return self.failure, None
        if not self.success:
            return "incomplete", None
        return ("completed", self.terminal[0]) if len(self.terminal) == 1 else ("conflict" if self.terminal else "no_result", None)


def accumulated(chunks: DataFrame) -> DataFrame:
    """task_id, status, text, lines and bad of provider streams (task_id, chunk_index, data); lines may be split anywhere."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        a = Accumulator()
        for data in g.sort_values("chunk_index", kind="stable")["data"]:
            a.feed(bytes(data))
        status, text = a.close()
        return pd.DataFrame([(g["task_id"].iloc[0], status, text, a.lines, a.bad)], columns=["task_id", "status", "text", "lines", "bad"])

    return chunks.groupBy("task_id").applyInPandas(fold, "task_id long, status string, text string, lines long, bad long")
