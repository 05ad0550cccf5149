"""Search over sections: full text, occurrences, terms and rankings.

Needles are few and given by the caller, so they become literals of the plan;
documents stay distributed. Hits are ordered by the documents' order, and a
limit takes the first of them with one more to tell that it was cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def full_text(sections: DataFrame, needle: str, context_lines: int = 1) -> DataFrame:
    """One hit for each section (doc_id, ordinal, title, text) whose title, or else text, holds the needle.

    Adds matched_in and snippet: the title and first line, or the lines around the first that matches, or where
    only the text as a whole matches, 300 characters around.
    """
    want = " ".join(needle.split()).lower()
    in_title = F.contains(T.normalized(F.col("title")), F.lit(want))
    in_text = F.contains(T.normalized(F.col("text")), F.lit(want))
    lines = F.filter(F.transform(F.split("text", "\n"), T.collapse), lambda x: x != "")
    hits = sections.where(in_title | in_text).select("*", lines.alias("_lines"), in_title.alias("_t"))
    at = F.coalesce(F.array_position(F.transform("_lines", lambda x: F.contains(F.lower(x), F.lit(want))), True), F.lit(0)).cast("int")
    hits = hits.withColumn("_at", at)
    start = F.greatest(F.lit(1), F.col("_at") - context_lines)
    around = F.array_join(F.slice("_lines", start, F.col("_at") + context_lines - start + 1), "\n")
    whole = F.array_join("_lines", " ")
    place = F.locate(want, F.lower(whole)) - 1
    a, b = F.greatest(F.lit(0), place - 300), F.least(F.length(whole), place + len(want) + 300)
    window = F.concat(F.when(a > 0, F.lit("…")).otherwise(""), F.trim(F.substring(whole, a + 1, b - a)), F.when(b < F.length(whole), F.lit("…")).otherwise(""))
    body = F.when(F.col("_at") > 0, around).when(place < 0, F.substring(whole, 1, 900)).otherwise(window)
    head = F.concat_ws("\n", "title", F.try_element_at("_lines", F.lit(1)))
    return hits.select(*sections.columns, F.when(F.col("_t"), "title").otherwise("text").alias("matched_in"), F.when(F.col("_t"), head).otherwise(body).alias("snippet"))


def limited(hits: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` hits, and truncated: whether there are more. Only limit + 1 rows leave each task."""
    first = hits.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)
    ranked = first.select("*", F.row_number().over(w).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_all"))
    return ranked.where(F.col("_n") <= limit).withColumn("truncated", F.col("_all") > limit).drop("_n", "_all")


def occurrence_counts(documents: DataFrame, needles: Sequence[str]) -> DataFrame:
    """doc_id and total: overlapping occurrences of any needle, for documents that have some."""
    total = sum((T.overlapping_count(F.col("text"), n) for n in needles), F.lit(0))
    return documents.where(_near(needles)).select("doc_id", total.cast("long").alias("total")).where("total > 0")


def search_mode(counts: DataFrame, limit: int, context_limit: int = 20) -> DataFrame:
    """One row: total, documents, and whether hits are listed (with context if few) or must be refined."""
    total = F.coalesce(F.sum("total"), F.lit(0))
    mode = F.when(F.col("total") > limit, "refinement_required").when(F.col("total") <= context_limit, "with_context").otherwise("occurrences")
    return counts.agg(total.alias("total"), F.count(F.lit(1)).alias("documents")).withColumn("mode", mode)


def _near(needles: Sequence[str]) -> Column:
    return F.rlike("text", F.lit("(?iU)" + "|".join(T.flexible(n) for n in needles)))


def occurrences(documents: DataFrame, needles: Sequence[str], excluded: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end, terms, line and col of each overlapping occurrence; needles at one place share a row.

    Offsets count in the text as it is. A text is cut where a needle begins, and only the measures of its pieces leave
    it; running sums over them give offsets, lines and columns. Occurrences within a range of ``excluded`` (doc_id, a,
    b; b not included) are left out. Ids are unique.
    """
    cut = F.array(*(_pieces(F.col("text"), n) for n in needles))
    rows = documents.where(_near(needles)).select("doc_id", F.posexplode(cut).alias("n", "pieces")).where(F.size("pieces") > 1)
    each = rows.select("doc_id", "n", F.posexplode("pieces").alias("i", "p")).select("doc_id", "n", "i", "p.*")
    w = Window.partitionBy("doc_id", "n").orderBy("i")
    start = F.sum("size").over(w) - 1  # a line end was put before the text
    line_start = F.max(F.when(F.col("line_ends") > 0, F.col("start") - F.col("tail"))).over(w)
    placed = each.withColumn("start", start).select("*", F.sum("line_ends").over(w).alias("line"), (F.col("start") - line_start + 1).alias("col")).where("match is not null")
    term = F.element_at(F.array(*(F.lit(" ".join(n.split()).lower()) for n in needles)), F.col("n") + 1)
    hits = placed.select("doc_id", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("match")).cast("int").alias("end"), F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), term.alias("term"))
    if excluded is not None:
        x = excluded.select(F.col("doc_id").alias("x_doc"), "a", "b")
        hits = hits.join(x, (F.col("doc_id") == F.col("x_doc")) & (F.col("start") >= F.col("a")) & (F.col("end") <= F.col("b")), "left_anti")
    return hits.groupBy("doc_id", "start", "end", "line", "col").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))


def _pieces(text: Column, needle: str) -> Column:
    """The text, with a line end before it, cut where the needle begins: size, line ends, characters after the last of them, and the length of the match behind."""
    pattern = T.flexible(needle)
    pieces = F.split(F.concat(F.lit("\n"), text), f"(?iU)(?={pattern})", -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(f"(?iU)(?=({pattern}))"), 1), F.length)
    measure = lambda p, i: F.struct(
        F.length(p).alias("size"), (F.length(p) - F.length(F.replace(p, F.lit("\n")))).alias("line_ends"),
        F.length(F.substring_index(p, "\n", -1)).alias("tail"), F.try_element_at(matches, i + 1).alias("match"),
    )
    return F.transform(pieces, measure)


def occurrence_search(documents: DataFrame, needles: Sequence[str], limit: int, context_lines: int = 0, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The summary (total, documents, mode) and the occurrences: none if there are more than ``limit``, with context (if any lines are asked for) if they are few."""
    hits = occurrences(documents, needles, excluded)
    counts = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    summary = search_mode(counts, limit)
    mode = summary.first()["mode"]
    shown = hits.where(F.lit(mode != "refinement_required"))
    if mode != "with_context" or not context_lines:
        return summary, shown.withColumn("context", F.lit(""))
    texts = documents.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    first = F.greatest(F.col("line") - context_lines, F.lit(1))
    around = F.array_join(F.slice("lines", first, F.col("line") + context_lines - first + 1), "\n")
    return summary, shown.join(texts, "doc_id").withColumn("context", around).drop("lines")


def top_titles(counts: DataFrame, titles: DataFrame, k: int = 50) -> DataFrame:
    """The documents with most hits: count descending, title, id."""
    joined = counts.join(titles, "doc_id").withColumn("folded", F.lower("title"))
    return joined.orderBy(F.desc("total"), "folded", "doc_id").limit(k).drop("folded")


def display_title(documents: DataFrame) -> DataFrame:
    """doc_id and title: the first line that isn't blank, else the id."""
    return documents.select("doc_id", F.coalesce(F.nullif(T.first_line(F.col("text")), F.lit("")), F.col("doc_id").cast("string")).alias("title"))


def search_text(sections: DataFrame) -> DataFrame:
    """Section text with its title in front, unless the first line holds it already."""
    first = T.first_line(F.col("text"))
    has = F.contains(F.lower(first), F.lower("title"))
    return sections.select(*[c for c in sections.columns if c != "text"], F.when(has, F.col("text")).otherwise(F.concat_ws("\n", "title", "text")).alias("text"))


def equation_terms(spans: DataFrame, terms: Sequence[str], limit: int) -> DataFrame:
    """Spans (doc_id, span_id, ordinal, label, tex, context) that hold a term; the best field of any term ranks them.

    Label equal 0, span id equal 0, label 1, formula 2, context 3.
    """
    distinct = list({t.lower(): " ".join(t.split()) for t in reversed(terms)}.items())[::-1]
    n = {c: T.normalized(F.col(c)) for c in ("label", "span_id", "tex", "context")}
    ranks, names = [], []
    for want, spelled in distinct:
        w = F.lit(want)
        rank = F.when((n["label"] == w) | (n["span_id"] == w), 0).when(F.contains(n["label"], w), 1).when(F.contains(n["tex"], w), 2).when(F.contains(n["context"], w), 3)
        ranks.append(rank)
        names.append(F.when(rank.isNotNull(), F.lit(spelled)))
    best = F.array_min(F.array(*ranks))
    out = spans.select("doc_id", "span_id", "ordinal", best.alias("rank"), F.array_join(F.array_compact(F.array(*names)), ",").alias("terms")).where(best.isNotNull())
    return limited(out, ["rank", "doc_id", "ordinal"], limit)


def term_counts(units: DataFrame, terms: Sequence[str]) -> DataFrame:
    """term, total and first (offset over all units in order, one character between) of terms that occur in units (unit, text).

    Each unit is counted where it is; a term's first unit is a minimum. Units have different numbers.
    """
    found = F.array(*(F.struct(F.lit(t).alias("term"), T.term_count(F.col("text"), [t]).alias("n"), F.regexp_instr("text", F.lit(T.term_pattern([t]))).alias("at")) for t in terms))
    hits = units.select("unit", F.explode(found).alias("x")).where("x.n > 0").select("unit", "x.*")
    counts = hits.groupBy("term").agg(F.sum("n").cast("long").alias("total"), F.min(F.struct("unit", "at")).alias("f")).select("term", "total", "f.*")
    return first_offsets(units, counts).select("term", "total", "first")


def first_offsets(units: DataFrame, firsts: DataFrame) -> DataFrame:
    """``firsts`` (term, unit, at from 1) with first: the offset over all units in order, one character between.

    ``firsts`` has a row for each term asked for, so it is broadcast; the sizes of the units before are summed where
    the units are, and no unit is put in order.
    """
    few = F.broadcast(firsts.select("term", F.col("unit").alias("until")))
    before = units.select("unit", F.length("text").alias("size")).join(few, F.col("unit") < F.col("until")).groupBy("term").agg(F.sum(F.col("size") + 1).alias("before"))
    return firsts.join(before, "term", "left").withColumn("first", (F.coalesce("before", F.lit(0)) + F.col("at") - 1).cast("long")).drop("before")


def top_terms(counts: DataFrame, approx: int) -> DataFrame:
    """The ceil(1.5 * approx) most frequent terms: count descending, first occurrence, term."""
    if not 1 <= approx <= 200:
        raise ValueError("approx must be between 1 and 200")
    return counts.orderBy(F.desc("total"), F.asc_nulls_last("first"), F.lower("term"), "term").limit((3 * approx + 1) // 2)


def quotas(chapters: DataFrame, total: int) -> DataFrame:
    """chapter and quota: one each, and the rest of ``total`` by size, leftovers to the largest remainders, then the first.

    With fewer to give than chapters, the largest chapters get one each.
    """
    everything = Window.partitionBy()
    n, size = F.count(F.lit(1)).over(everything), F.sum("size").over(everything)
    rows = chapters.select("chapter", "size", n.alias("n"), size.alias("all"))
    rest = F.greatest(F.lit(total) - F.col("n"), F.lit(0))
    share = F.when(F.col("all") > 0, F.floor(rest * F.col("size") / F.col("all"))).otherwise(0).cast("long")
    left = F.when(F.col("all") > 0, F.pmod(rest * F.col("size"), F.col("all"))).otherwise(0)
    rows = rows.select("*", share.alias("share"), left.alias("left"), rest.alias("rest"))
    rank = F.row_number().over(Window.orderBy(F.desc("left"), "chapter"))
    open_ = F.col("rest") - F.sum("share").over(everything)
    return rows.select("chapter", (1 + F.col("share") + (rank <= open_).cast("long")).alias("quota"))


def windows(entries: DataFrame, order: str, size: int = 80) -> DataFrame:
    """Entries numbered in windows of a fixed count, in order."""
    return entries.withColumn("window", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("long"))


def sentences(units: DataFrame) -> DataFrame:
    """unit, position and sentence, cut after . ! ? and at line ends."""
    parts = F.split("text", r"(?<=[.!?])\s+|\n+")
    rows = units.select("unit", F.posexplode(parts).alias("position", "sentence"))
    return rows.select("unit", "position", T.collapse(F.col("sentence")).alias("sentence")).where("sentence <> ''")


def first_distinct(rows: DataFrame, key: str, order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows with different keys, in order; ties by the whole order."""
    once = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return once.orderBy(*order).limit(k)
