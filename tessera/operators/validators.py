"""Checks of parsed documents and records: one row for each rule that is broken; sound input gives no rows.

Everything is grouped by document, and within it by list or item, so a check grows with a document and not with the
corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrow import canonical_json
from tessera.functions.json_tools import schema_errors


def list_path_errors(blocks: DataFrame, path: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """doc_id, rule and subject of broken list ancestry.

    ``blocks`` has doc_id, ordinal, kind, section, items (of a list block) and ordered; ``path`` has an entry of a
    block's list path a row: doc_id, ordinal, place (from 0), depth, container_id, container_source, item_id,
    item_source, item_index, item_count, segment and ordered. ``sections``: doc_id, section, first, last (not included).
    """
    w = Window.partitionBy("doc_id", "ordinal")
    above = F.array_join(F.collect_list(F.concat_ws("/", "container_id", "item_id")).over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), ">")
    rows = path.join(blocks.select("doc_id", "ordinal", "section", "kind", "items", F.col("ordered").alias("b_ordered")), ["doc_id", "ordinal"])
    rows = rows.withColumn("above", above).withColumn("deepest", F.max("place").over(w) == F.col("place"))
    out: list[DataFrame] = []

    def broken(df: DataFrame, rule: str, subject: Column | str, when: Column | str) -> None:
        subject = F.col(subject) if isinstance(subject, str) else subject
        out.append(df.where(when).select("doc_id", F.lit(rule).alias("rule"), subject.cast("string").alias("subject")))

    broken(rows.where("place = 0"), "heading_with_path", "ordinal", "kind = 'heading'")
    broken(rows.where("place = 0"), "items_of_list", "ordinal", "kind = 'list' and items <> 1")
    broken(rows.where("deepest"), "order_of_list", "ordinal", "kind = 'list' and b_ordered <> ordered")
    broken(rows, "depth", "ordinal", "depth <> place")
    for what in ("container", "item"):
        twice = rows.groupBy("doc_id", "ordinal", f"{what}_id").agg(F.count(F.lit(1)).alias("n"))
        broken(twice, f"repeated_{what}", f"{what}_id", "n > 1")
    container = F.struct("container_source", "item_count", "depth", "ordered", "above", "section")
    item = F.struct("container_id", "item_source", "item_index", "item_count", "depth", "ordered", "above", "section")
    for what, definition in (("container", container), ("item", item)):
        facts = rows.groupBy("doc_id", f"{what}_id").agg(
            F.min(definition).alias("a"), F.max(definition).alias("b"), F.min("ordinal").alias("first"), F.max("ordinal").alias("end"), F.count_distinct("ordinal").alias("n"))
        broken(facts, f"conflicting_{what}", f"{what}_id", F.col("a") != F.col("b"))
        broken(facts, f"gap_in_{what}", f"{what}_id", "end - first + 1 <> n")
    owners = rows.select("doc_id", F.col("container_source").alias("source"), F.concat(F.lit("c:"), "container_id").alias("owner"))
    owners = owners.unionByName(rows.select("doc_id", F.col("item_source").alias("source"), F.concat(F.lit("i:"), "item_id").alias("owner")))
    broken(owners.groupBy("doc_id", "source").agg(F.min("owner").alias("a"), F.max("owner").alias("b")), "owners_of_source", "source", "source is not null and a <> b")
    indexes = rows.groupBy("doc_id", "container_id", "item_index").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b"), F.min("ordinal").alias("first"), F.max("item_count").alias("item_count"))
    broken(indexes, "items_of_index", F.concat_ws("#", "container_id", "item_index"), "a <> b")
    cover = indexes.groupBy("doc_id", "container_id").agg(F.min("item_index").alias("low"), F.max("item_index").alias("high"), F.count(F.lit(1)).alias("n"), F.max("item_count").alias("item_count"))
    broken(cover, "items_covered", "container_id", "low <> 0 or high <> n - 1 or item_count <> n")
    by_index = Window.partitionBy("doc_id", "container_id").orderBy("item_index")
    order = indexes.withColumn("before", F.lag("first").over(by_index)).where("first < before").select("doc_id", "container_id").distinct()
    broken(order, "order_of_items", "container_id", F.lit(True))
    segments = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy("ordinal")) - 1).where("segment <> nth").select("doc_id", "item_id").distinct()
    broken(segments, "segments", "item_id", F.lit(True))
    if sections is not None:
        placed = rows.where("place = 0").join(sections, ["doc_id", "section"], "left")
        broken(placed, "section_of_block", "ordinal", "first is null or ordinal < first or ordinal >= last")
    return reduce(DataFrame.unionByName, out)


def schema_violations(records: DataFrame, schema: dict) -> DataFrame:
    """id, path and rule for each rule of a JSON schema that a record (id, value) breaks; a text that is no JSON breaks "json".

    A closed contract (no other fields, all named ones) is a schema with required and additionalProperties false.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in batch.itertuples(index=False):
                try:
                    rows += [(i, path, rule) for path, rule in schema_errors(json.loads(text), schema)]
                except (TypeError, ValueError):
                    rows.append((i, "$", "json"))
            yield pd.DataFrame(rows, columns=["id", "path", "rule"])

    return records.select("id", "value").mapInPandas(run, "id long, path string, rule string")


def digest_mismatches(records: DataFrame) -> DataFrame:
    """Ids of the records (id, value, digest) whose digest isn't that of the value's canonical JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for i, text, digest in batch.itertuples(index=False):
                try:
                    same = hashlib.sha256(canonical_json(json.loads(text)).encode()).hexdigest() == digest
                except (TypeError, ValueError):
                    same = False
                if not same:
                    bad.append(i)
            yield pd.DataFrame({"id": pd.Series(bad, dtype="int64")})

    return records.select("id", "value", "digest").mapInPandas(run, "id long")


def verified_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources (doc_id, format, text, digest) whose text has the digest recorded, and doc_id with error for the others."""
    same = F.sha2(F.col("text").cast("binary"), 256).eqNullSafe(F.col("digest"))
    return sources.where(same).drop("digest"), sources.where(~same).select("doc_id", F.lit("digest_mismatch").alias("error"))


#: Kinds of targets.
TARGET_KINDS = ("section", "paragraph", "equation", "table", "figure", "list", "code")


def target_errors(targets: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, target and rule of broken targets of links.

    ``targets``: doc_id, target (number), alias, selector, kind, block_id, first, last (not included), section_id
    (empty but for sections) and panels (ids); ``blocks``: doc_id, block_id, ordinal, kind; ``sections``: doc_id,
    section_id, first, last.
    """
    n = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    own = blocks.select("doc_id", "block_id", F.col("ordinal").alias("b_ordinal"), F.col("kind").alias("b_kind"))
    part = sections.select("doc_id", "section_id", F.col("first").alias("s_first"), F.col("last").alias("s_last"))
    again = F.row_number().over(Window.partitionBy("doc_id", "alias").orderBy("target")) > 1
    t = targets.withColumn("again", again).join(n, "doc_id", "left").join(own, ["doc_id", "block_id"], "left").join(part, ["doc_id", "section_id"], "left")
    section = F.col("kind") == "section"
    rules = {
        "alias": (F.col("alias") == "") | F.col("again"),
        "selector": F.col("selector") != F.concat(F.lit("#"), "alias"),
        "kind": ~F.col("kind").isin(*TARGET_KINDS),
        "block": F.col("b_ordinal").isNull(),
        "range": ~((F.col("first") >= 0) & (F.col("first") < F.col("last")) & (F.col("last") <= F.coalesce("n_blocks", F.lit(0)))),
        "start": F.col("b_ordinal") != F.col("first"),
        "section": section & (F.col("s_first").isNull() | (F.col("s_first") != F.col("first")) | (F.col("s_last") != F.col("last")) | (F.col("b_kind") != "heading")),
        "section_id": ~section & (F.col("section_id") != ""),
        "one_block": ~section & (F.col("last") != F.col("first") + 1),
        "kind_of_block": ~section & (F.col("kind") != F.col("b_kind")),
        "panels": (F.col("kind") != "figure") & (F.size("panels") > 0),
    }
    broken = t.select("doc_id", "target", F.explode(F.array_compact(F.array(*(F.when(w, F.lit(r)) for r, w in rules.items())))).alias("rule"))
    panels = targets.select("doc_id", "target", F.posexplode("panels").alias("place", "id"))
    twice = panels.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("target", "place"))).where("r > 1").select("doc_id", "target", F.lit("panel_again").alias("rule")).distinct()
    taken = panels.join(targets.select("doc_id", F.col("alias").alias("id")).distinct(), ["doc_id", "id"], "left_semi").select("doc_id", "target", F.lit("panel_alias").alias("rule")).distinct()
    return broken.unionByName(twice).unionByName(taken)
