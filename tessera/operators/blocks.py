"""Repairs and groupings of parsed blocks, and identities that leave defaults out."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrow import canonical_json


class NotUnique(ValueError):
    """A fragment that occurs never or more than once."""


def repair(paragraph: str, fragment: str, parts: list[tuple[str, str]], most: int = 8000) -> list[tuple[str, str]]:
    """The paragraph as typed parts (text, math, sup), with the one occurrence of the fragment replaced."""
    if sum(len(t) for _, t in parts) > most or any(k not in ("text", "math", "sup") for k, _ in parts):
        raise ValueError("invalid_parts")
    if not fragment or paragraph.count(fragment) != 1:
        raise NotUnique(fragment)
    before, after = paragraph.split(fragment)
    out: list[tuple[str, str]] = []
    for kind, text in [("text", before), *parts, ("text", after)]:
        if text and out and kind == "text" == out[-1][0]:
            out[-1] = (kind, out[-1][1] + text)
        elif text:
            out.append((kind, text))
    return out


def inline(parts: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """Text of typed parts with white space collapsed across them, and the span of each part in it."""
    text, spans = "", []
    for kind, part in parts:
        part = re.sub(r"\s+", " ", part) if kind == "text" else part.strip()
        if text.endswith(" ") or not text:
            part = part.lstrip(" ")
        spans.append((len(text), len(text) + len(part), kind))
        text += part
    bare = text.rstrip()
    return bare, [(min(a, len(bare)), min(b, len(bare)), k) for a, b, k in spans]


def semantic_key(values: dict, defaults: dict) -> str:
    """SHA-256 of the canonical JSON of the values that aren't defaults, so that new fields don't change old keys."""
    kept = {k: v for k, v in values.items() if k not in defaults or v != defaults[k]}
    return hashlib.sha256(canonical_json(kept).encode()).hexdigest()


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """task_id, digest, ordinal and terminal of candidates (task_id, ordinal, digest, terminal) with one row a digest."""
    return candidates.groupBy("task_id", "digest").agg(F.min("ordinal").alias("ordinal"), F.bool_or("terminal").alias("terminal"))


def equation_rows(rows: DataFrame) -> DataFrame:
    """doc_id, row and group: rows without a tag join the nearest tagged row, the earlier of two as near.

    Nearest rows before and after are carried by windows instead of comparing all rows.
    """
    w = Window.partitionBy("doc_id").orderBy("row")
    tagged = F.when(F.col("tag").isNotNull(), F.col("row"))
    before = F.last(tagged, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(tagged, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = rows.withColumn("b", before).withColumn("a", after)
    near = F.when(F.col("a").isNull() | (F.col("row") - F.col("b") <= F.col("a") - F.col("row")), F.col("b")).otherwise(F.col("a"))
    return both.select("doc_id", "row", F.coalesce(near, F.col("a"), F.col("b")).alias("group"))


def visible_content(units: DataFrame) -> DataFrame:
    """doc_id with emitted, excluded, opaque and unaccounted units (doc_id, disposition); a sound document leaves none unaccounted."""
    n = lambda d: F.count_if(F.col("disposition") == d).alias(d)
    return units.groupBy("doc_id").agg(n("emitted"), n("excluded"), n("opaque"), F.count_if(F.col("disposition").isNull() | ~F.col("disposition").isin("emitted", "excluded", "opaque")).alias("unaccounted"))


def revision_errors(before: DataFrame, after: DataFrame) -> DataFrame:
    """block_id and rule for reviewed revisions (block_id, kind, text, anchors): kinds stay, blocks stay, anchors lie in the text and match it."""

    def check(kind_b, kind_a, text, anchors) -> str | None:
        if kind_a is None:
            return "removed"
        if kind_b is None:
            return "added"
        if kind_a != kind_b:
            return "kind"
        ok = all(0 <= s <= e <= len(text or "") and (text or "")[s:e] == m for s, e, m in anchors if not pd.isna(s))
        return None if ok else "anchor"

    both = before.select("block_id", F.col("kind").alias("kb")).join(after.select("block_id", F.col("kind").alias("ka"), "text", "anchors"), "block_id", "full_outer")

    def run(batches):
        for batch in batches:
            rows = [(b, check(kb, ka, t, [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in (a if a is not None else [])])) for b, kb, ka, t, a in batch.itertuples(index=False)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["block_id", "rule"])

    return both.select("block_id", "kb", "ka", "text", "anchors").mapInPandas(run, "block_id long, rule string")
