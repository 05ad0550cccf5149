"""Blocks of a parsed document made whole: identities, section tree, targets of links, and optional parts that must be sound to stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import sections as S


def _id(prefix: str, length: int, **fields: Column) -> Column:
    """A prefix and the first digits of the SHA-256 of the fields as canonical JSON."""
    value = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix), F.left(F.sha2(value.cast("binary"), 256), F.lit(length)))


def section_tree(blocks: DataFrame) -> DataFrame:
    """doc_id, section_id, title, level, first, last (not included) and path (ids from the outermost) of each section.

    ``blocks``: doc_id, source, ordinal (from 0 without gaps), kind, level, text, payload, source_id. Each heading opens
    a section; blocks in front of the first heading are in a section of level 1 called Document.
    """
    head = F.col("kind") == "heading"
    front = F.col("ordinal") == F.min("ordinal").over(Window.partitionBy("doc_id"))
    entries = blocks.withColumn("made", front & ~head).where(head | F.col("made"))
    made = _id("sec-", 20, source=F.col("source"), role=F.lit("synthetic-document-section"))
    own = _id("sec-", 20, source=F.col("source"), ordinal=F.col("ordinal"), level=F.col("level"), title=F.col("text"))
    entries = entries.select(
        "doc_id", "ordinal", F.when(F.col("made"), 1).otherwise(F.col("level")).alias("level"), F.when(F.col("made"), "Document").otherwise(F.col("text")).alias("title"), F.when(F.col("made"), made).otherwise(own).alias("section_id"),
    )
    size = blocks.groupBy("doc_id").agg(F.max("ordinal").alias("final"))
    placed = S.ends(S.paths(entries).join(size, "doc_id"), "final")
    known = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.map_from_entries(F.collect_list(F.struct("ordinal", "section_id")).over(known))
    return placed.select("doc_id", "section_id", "title", "level", F.col("ordinal").alias("first"), (F.col("end") + 1).alias("last"), F.transform("path", lambda o: F.try_element_at(seen, o)).alias("path"))


def with_identity(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, ordinal, kind, block_id, source_id and path (of the innermost section) of each block."""
    starts = sections.select("doc_id", F.col("first").alias("ordinal"), "path")
    last = F.last("path", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    block_id = _id("block-", 24, **{c: F.col(c) for c in ("kind", "ordinal", "payload", "source", "source_id")})
    return blocks.join(starts, ["doc_id", "ordinal"], "left").select("doc_id", "ordinal", "kind", block_id.alias("block_id"), "source_id", last.alias("path"))


def target_manifest(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Targets of links (the columns that ``validators.target_errors`` takes): each block with an authored id.

    A heading's target is its section. An id that a document has twice names no block and is left out.
    """
    once = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "source_id")) == 1
    named = blocks.where("source_id <> ''").withColumn("once", once).where("once")
    part = sections.select("doc_id", F.col("first").alias("ordinal"), "section_id", "last")
    head = F.col("kind") == "heading"
    both = named.join(part, ["doc_id", "ordinal"], "left").withColumn("target", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")) - 1)
    return both.select(
        "doc_id", "target", F.col("source_id").alias("alias"), F.concat(F.lit("#"), "source_id").alias("selector"), F.when(head, "section").otherwise(F.col("kind")).alias("kind"), "block_id",
        F.col("ordinal").alias("first"), F.when(head, F.col("last")).otherwise(F.col("ordinal") + 1).alias("last"), F.when(head, F.col("section_id")).otherwise("").alias("section_id"), F.array().cast("array<string>").alias("panels"),
    )


def admitted(rows: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of documents without errors, and (doc_id, errors) of those that lose this optional part as a whole."""
    lost = errors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("errors"))
    return rows.join(lost, "doc_id", "left_anti"), lost
