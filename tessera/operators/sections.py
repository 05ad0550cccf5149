"""Sections and lines: parents, ranges, slices, context, markers and selectors.

Everything is partitioned by document, so the windows grow with a document and
not with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def toc(sections: DataFrame) -> DataFrame:
    """The section inventory without texts."""
    return sections.drop("text")


#: More levels than this are an error: each is a column of a window.
MOST_LEVELS = 64


def _levels(entries: DataFrame) -> list[int]:
    """The levels there are, ascending; read from the data, so that none is left out."""
    found = sorted(r.level for r in entries.select("level").where("level is not null").distinct().limit(MOST_LEVELS + 1).collect())
    if len(found) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels")
    return found or [1]


def parents(entries: DataFrame) -> DataFrame:
    """Adds parent: the ordinal of the nearest earlier entry (doc_id, ordinal, level) of a lower level, or null.

    Levels are few, so the last ordinal of each level is carried along instead of joining entries with each other.
    """
    levels = _levels(entries)
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    lower = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("ordinal"))).over(w)) for k in levels]
    return entries.withColumn("parent", F.array_max(F.array(*lower)))


def ends(entries: DataFrame, last: str) -> DataFrame:
    """Adds end: the ordinal before the next entry of the same or a lower level, else the document's last."""
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("ordinal"))).over(w)) for k in _levels(entries)]
    return entries.withColumn("end", F.coalesce(F.array_min(F.array(*nexts)) - 1, F.col(last)))


def slices(headings: DataFrame, last: str) -> DataFrame:
    """Adds stop: the line before the next heading (doc_id, line), else the document's last."""
    w = Window.partitionBy("doc_id").orderBy("line")
    return headings.withColumn("stop", F.coalesce(F.lead("line").over(w) - 1, F.col(last)))


def paths(entries: DataFrame) -> DataFrame:
    """Adds path: the ordinals from the outermost enclosing entry to the entry itself."""
    levels = _levels(entries)
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = entries.select("*", *(F.max(F.when(F.col("level") == k, F.col("ordinal"))).over(w).alias(f"_l{i}") for i, k in enumerate(levels)))
    open_, lower = [], F.lit(-1)
    for i, k in enumerate(levels):  # an entry of a level is open if no entry of a lower one came after it
        here = F.col(f"_l{i}")
        open_.append(F.when((F.col("level") >= k) & (here > lower), here))
        lower = F.greatest(lower, here)
    return carried.withColumn("path", F.array_compact(F.array(*open_))).drop(*(f"_l{i}" for i in range(len(levels))))


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, line (from 1) and text of every line."""
    split = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return split.select("doc_id", (F.col("i") + 1).alias("line"), "text")


def source_range(documents: DataFrame, first: int, last: int) -> DataFrame:
    """Lines ``first`` to ``last``, both included, of each document; only the slice is exploded."""
    cut = F.slice(F.split("text", "\n", -1), first, last - first + 1)
    rows = documents.where("text is not null").select("doc_id", F.posexplode(cut).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + first).alias("line"), "text")


def context(rows: DataFrame, n: int) -> DataFrame:
    """Adds around: the lines from n before to n after, joined."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(-n, n)
    return rows.withColumn("around", F.array_join(F.collect_list("text").over(w), "\n"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Adds before and after: the nearest lines around that aren't blank."""
    w = Window.partitionBy("doc_id").orderBy("line")
    filled = F.when(F.trim("text") != "", F.trim("text"))
    return rows.select(
        "*",
        F.last(filled, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first(filled, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )


def marked(rows: DataFrame, group: str, order: list[str], marker: str, out: str) -> DataFrame:
    """As-of, backward: each row gets the last value of ``marker`` strictly before it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(marker, ignorenulls=True).over(w))


def following(rows: DataFrame, group: str, order: list[str], marker: str, out: str) -> DataFrame:
    """As-of, forward: each row gets the first value of ``marker`` strictly after it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(out, F.first(marker, ignorenulls=True).over(w))


def overlapping(left: DataFrame, right: DataFrame, key: str, cell: int) -> DataFrame:
    """Pairs of (lid, a, b) and (rid, c, d) of one key whose closed ranges overlap.

    Ranges are spread over cells of a fixed width and joined by key and cell; a pair is kept in the first cell it shares.
    """
    spread = lambda df, a, b: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))))
    pairs = spread(left, "a", "b").join(spread(right, "c", "d"), [key, "cell"]).where("b >= c and a <= d")
    return pairs.where(F.col("cell") == F.floor(F.greatest("a", "c") / cell)).drop("cell")


def select_section(sections: DataFrame, selector: int | str) -> DataFrame:
    """One row for each document: the section selected, or error: section_not_found, section_ambiguous.

    A number selects by ordinal; a text by id or title, or else by part of a title.
    """
    if isinstance(selector, int):
        tier = F.when(F.col("ordinal") == selector, 1)
    else:
        want = " ".join(selector.split()).lower()
        title = T.normalized(F.col("title"))
        tier = F.when((title == want) | (T.normalized(F.col("section_id")) == want), 1).when(F.contains(title, F.lit(want)), 2)
    rows = sections.withColumn("tier", tier)
    best = F.min("tier").over(Window.partitionBy("doc_id"))
    kept = rows.withColumn("best", best).groupBy("doc_id").agg(
        F.count_if(F.col("tier") == F.col("best")).alias("n"), F.min_by("section_id", F.when(F.col("tier") == F.col("best"), F.col("ordinal"))).alias("section_id")
    )
    error = F.when(F.col("n") == 0, "section_not_found").when(F.col("n") > 1, "section_ambiguous")
    return kept.select("doc_id", F.when(F.col("n") == 1, F.col("section_id")).alias("section_id"), error.alias("error"))


def strictly_increasing(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value isn't above the one before in the group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).where(F.col(value) <= F.col("previous"))


def islands(rows: DataFrame, group: str, order: str, kind: str, collapsing: str) -> DataFrame:
    """group and expected: rows, where a run of adjacent rows of one kind counts once."""
    w = Window.partitionBy(group).orderBy(order)
    repeat = (F.col(kind) == collapsing) & (F.coalesce(F.lag(kind).over(w), F.lit("")) == collapsing)
    return rows.withColumn("_c", (~repeat).cast("long")).groupBy(group).agg(F.sum("_c").alias("expected"))
