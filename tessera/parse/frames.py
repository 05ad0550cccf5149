"""Parsers over DataFrames: one row of source gives many rows; an error gives a row with its code and fails no job.

Sources have doc_id, format (html, markdown, tex) and text. A null text has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.parse import html, markdown, meaning, rich, spans, tex

PARSERS = {"html": html, "markdown": markdown, "tex": tex}


def _code(e: Exception) -> str:
    return {spans.Unclosed: "unclosed_span", tex.Unsupported: "unsupported_include"}.get(type(e), "invalid_source")


def _rows(source: DataFrame, schema: str, produce: Callable[[str, str], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, kind, text in batch.itertuples(index=False):
                if text is None:
                    continue
                if kind not in PARSERS:
                    out.append((doc_id, *[None] * (len(names) - 2), "unsupported_source"))
                    continue
                try:
                    out += [(doc_id, *r, None) for r in produce(kind, text)]
                except (ValueError, RecursionError) as e:
                    out.append((doc_id, *[None] * (len(names) - 2), _code(e)))
            yield pd.DataFrame(out, columns=names).astype(object)

    return source.select("doc_id", "format", "text").mapInPandas(run, schema)


def sections(source: DataFrame) -> DataFrame:
    return _rows(source, "doc_id long, ordinal int, title string, level int, line int, text string, error string", lambda k, t: [(s.ordinal, s.title, s.level, s.line, s.text) for s in PARSERS[k].sections(t)])


def formulas(source: DataFrame) -> DataFrame:
    return _rows(source, "doc_id long, ordinal int, kind string, tex string, label string, error string", lambda k, t: [(i, s.kind, s.tex, s.label) for i, s in enumerate(PARSERS[k].spans(t))])


def terms(source: DataFrame) -> DataFrame:
    return _rows(source, "doc_id long, ordinal int, term string, error string", lambda k, t: list(enumerate(PARSERS[k].terms(t))))


def blocks(source: DataFrame) -> DataFrame:
    """Blocks in order, of all three formats; lines are known for Markdown only."""

    def of(k: str, t: str) -> list[tuple]:
        if k == "markdown":
            return [(i, b.kind, b.line, b.end, b.level, None, None, b.text) for i, b in enumerate(markdown.blocks(t))]
        found = rich.html_blocks(t) if k == "html" else rich.tex_blocks(t)
        return [(i, b.kind, None, None, b.level, b.role, b.caption, b.text) for i, b in enumerate(found)]

    return _rows(source, "doc_id long, ordinal int, kind string, line int, end int, level int, role string, caption string, text string, error string", of)


def segments(pages: DataFrame) -> DataFrame:
    """Inline segments of the paragraphs of pages."""
    return _rows(pages, "doc_id long, block int, ordinal int, kind string, text string, target string, error string", lambda k, t: [(i, j, *s) for i, b in enumerate(rich.html_blocks(t)) if b.kind == "paragraph" for j, s in enumerate(b.parts)])


def notes(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, anchor string, marker string, body string, error string", lambda k, t: rich.notes(t))


def authors(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, ordinal int, name string, orcid string, affiliations array<string>, error string", lambda k, t: rich.authors(t))


def dependencies(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, ordinal int, element string, attribute string, address string, error string", lambda k, t: html.dependencies(t))


def list_items(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, path string, kind string, text string, error string", lambda k, t: html.list_items(t))


def table_cells(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, table int, row int, col int, rows int, cols int, header boolean, text string, error string", lambda k, t: [(i, *c) for i, g in enumerate(html.tables(t)) for c in g])


def heading_roles(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, ordinal int, title string, level int, role string, problem string, error string", lambda k, t: meaning.heading_roles(t))


def equations(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, ordinal int, tex string, label string, error string", lambda k, t: meaning.equations(t))


def captions(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, ordinal int, kind string, text string, placement string, alignment string, problem string, error string", lambda k, t: meaning.captions(t))


def panels(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, figure int, panel int, layout string, row int, col int, target string, width int, height int, ratio string, problem string, error string", lambda k, t: meaning.panels(t))


def loose_media(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, ordinal int, element string, target string, alt string, error string", lambda k, t: meaning.loose_media(t))


def drawings(pages: DataFrame) -> DataFrame:
    return _rows(pages, "doc_id long, ordinal int, start int, end int, svg string, error string", lambda k, t: meaning.drawings(t))
