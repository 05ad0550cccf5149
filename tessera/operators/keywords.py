"""Text units for keyword extraction, without the terms that a document states itself."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tessera.functions import text as T
from tessera.functions.arrow import normalize_term_text


def without_stated(text: str, fields: list[dict]) -> str:
    """The text without stated terms: fields have entries and a label (or kind).

    A text that lists nothing but a field's entries becomes empty. Otherwise what stands behind the label goes (a
    bracketed list, the rest of the line, and a list below), then the entries one after another, then a TeX command
    that holds them.
    """
    for one in fields:
        entries = one.get("entries") if isinstance(one, dict) else None
        terms = [t for t in (str(e).strip() for e in entries) if t] if isinstance(entries, list) else []
        if not terms:
            continue
        known = set(map(normalize_term_text, terms))
        said = [normalize_term_text(re.sub(r"^\s*[-*+]\s*", "", x)) for x in text.splitlines() if x.strip()]
        if said and known.issuperset(said):
            return ""
        quoted = [re.escape(t) for t in terms]
        label = str(one.get("label") or one.get("kind") or "").strip()
        steps = [r"\s*(?:[,;]|\s)\s*".join(quoted), r"\\key(?:words?|terms?)\*?\s*\{" + r"\s*[,;]\s*".join(quoted) + r"\}"]
        if label:
            steps.insert(0, rf"^\s*{re.escape(label)}\s*:\s*(?:\[[^\n]*\]|[^\n]*(?:\n\s*[-*+]\s*[^\n]+)*)")
        for step in steps:
            text = re.sub(step, " ", text, flags=re.IGNORECASE | re.MULTILINE | re.DOTALL)
    return text


@pandas_udf(StringType())
def without_stated_terms(text: pd.Series, fields: pd.Series) -> pd.Series:
    """``without_stated`` for a text and its document's fields as a JSON list (null: none)."""
    return pd.Series([None if t is None else without_stated(t, json.loads(f) if f else []) for t, f in zip(text, fields, strict=True)])


def text_units(blocks: DataFrame, fields: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ordinal, section_id, title, text and page of blocks (doc_id, ordinal, section_id, title, text) that have text and stand in no section of terms.

    ``fields`` has doc_id and fields (JSON), ``pages`` doc_id, ordinal and page.
    """
    kept = blocks.where((F.trim("text") != "") & ~T.is_term_title(F.coalesce("title", F.lit(""))))
    joined = kept.join(fields.select("doc_id", "fields"), "doc_id", "left").join(pages.select("doc_id", "ordinal", "page"), ["doc_id", "ordinal"], "left")
    return joined.select("doc_id", "ordinal", "section_id", "title", without_stated_terms("text", "fields").alias("text"), "page")
