"""Matching two renditions of the same text: titles, headings, anchors, phrases and formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def structure(primary: DataFrame, validator: DataFrame) -> DataFrame:
    """doc_id and status: verified if both have the same titles in order (as fingerprints), else mismatch."""
    titles = lambda df, c: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", T.fingerprint(F.col("title")).alias("t")))).alias(c))
    both = titles(primary, "p").join(titles(validator, "v"), "doc_id", "full_outer")
    same = F.transform("p", lambda x: x["t"]).eqNullSafe(F.transform("v", lambda x: x["t"]))
    return both.select("doc_id", F.when(same, "verified").otherwise("mismatch").alias("status"))


def page_lines(pages: DataFrame) -> DataFrame:
    """Page lines (doc_id, page, line, text) with their fingerprints."""
    return pages.withColumn("fp", T.fingerprint(F.col("text")))


def exact_titles(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, key and page of every line that equals a title, also without the title's number. lines have fp."""
    keys = titles.select("doc_id", "key", F.explode(F.array_distinct(F.array(T.fingerprint(F.col("title")), T.fingerprint(T.strip_section_number(F.col("title")))))).alias("fp"))
    return keys.where("fp <> ''").join(lines, ["doc_id", "fp"]).select("doc_id", "key", "page").distinct()


def joined_titles(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """As ``exact_titles``, for titles that go over two or three lines."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    two = F.concat_ws(" ", "fp", F.lead("fp", 1).over(w))
    three = F.concat_ws(" ", "fp", F.lead("fp", 1).over(w), F.lead("fp", 2).over(w))
    spread = lines.select("doc_id", "page", two.alias("f2"), three.alias("f3"), F.lead("fp", 2).over(w).isNotNull().alias("has3"), F.lead("fp", 1).over(w).isNotNull().alias("has2"))
    joined = spread.select("doc_id", "page", F.explode(F.array_compact(F.array(F.when(F.col("has2"), F.col("f2")), F.when(F.col("has3"), F.col("f3"))))).alias("fp"))
    return exact_titles(titles, joined)


def shingles(rows: DataFrame, size: int, longest: int | None = None) -> DataFrame:
    """Each row's (all columns but text) runs of ``size`` tokens, as 64-bit hashes, with start; of the first ``longest`` tokens if given."""
    tokens = _hashed(F.split(T.fingerprint(F.col("text")), " "))
    tokens = F.slice(tokens, 1, longest) if longest else tokens
    kept = rows.select(*[c for c in rows.columns if c != "text"], tokens.alias("t")).where(F.size("t") >= size)
    runs = F.transform(F.sequence(F.lit(1), F.size("t") - size + 1), lambda i: F.xxhash64(F.slice("t", i, size)))
    return kept.select(*[c for c in rows.columns if c != "text"], F.posexplode(runs).alias("start", "shingle"))


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def body_anchors(bodies: DataFrame, pages: DataFrame, size: int = 8, longest: int = 128) -> DataFrame:
    """key, start, page: the first run of tokens of a body that stands on exactly one page.

    Hashes find the candidates, the texts of which decide.
    """
    near = shingles(bodies, size, longest).join(shingles(pages, size).select("shingle", "page"), "shingle").select("key", "start", "page").distinct()
    said = bodies.select("key", F.split(T.fingerprint(F.col("text")), " ").alias("t"))
    fps = pages.select("page", T.fingerprint(F.col("text")).alias("pf"))
    run = F.array_join(F.slice("t", F.col("start") + 1, size), " ")
    hits = near.join(said, "key").select("key", "start", "page", run.alias("run")).join(fps, "page").where(F.contains(_padded(F.col("pf")), _padded(F.col("run"))))
    only = hits.groupBy("key", "start").agg(F.min("page").alias("page"), F.max("page").alias("other")).where("page = other")
    return only.groupBy("key").agg(F.min("start").alias("start"), F.min_by("page", "start").alias("page"))


def phrase_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """key and page of blocks whose fingerprint is part of exactly one page's, by whole tokens.

    Evidence has two tokens at least, so candidate pages hold the block's first two; the whole phrase is looked for on
    those only. Texts stay out of the candidate join, and so do pairs that begin no phrase.
    """
    b = blocks.select("key", T.fingerprint(F.col("text")).alias("fp")).where(T.has_page_evidence(F.col("fp")))
    first = b.select("key", F.xxhash64(_hashed(F.slice(F.split("fp", " "), 1, 2))).alias("shingle"))
    near = shingles(pages.select("page", "text"), 2).select("page", "shingle").join(first, "shingle").select("key", "page").distinct()
    fps = pages.select("page", T.fingerprint(F.col("text")).alias("pf"))
    hits = near.join(b, "key").join(fps, "page").where(F.contains(_padded(F.col("pf")), _padded(F.col("fp"))))
    return hits.groupBy("key").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def best_evidence(evidence: DataFrame) -> DataFrame:
    """key, page and tier by priority of (key, page, tier): unique before any, exact before joined before anchor before part."""
    n = F.count(F.lit(1)).over(Window.partitionBy("key", "tier"))
    rank = F.when((n == 1) & (F.col("tier") == "exact"), 1).when((n == 1) & (F.col("tier") == "joined"), 2).when((n == 1) & (F.col("tier") == "anchor"), 3)
    rank = rank.when(F.col("tier") == "exact", 4).when(F.col("tier") == "joined", 5).when(F.col("tier") == "anchor", 6).otherwise(7)
    w = Window.partitionBy("key").orderBy("rank", "page")
    return evidence.withColumn("rank", rank).withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "page", "tier")


def shared_words(left: DataFrame, right: DataFrame, stop: list[str]) -> DataFrame:
    """key and shared: how many distinct words of four letters or more both texts have, without stop words."""
    words = lambda c: F.array_except(F.filter(F.split(T.fingerprint(F.col(c)), " "), lambda x: F.length(x) >= 4), F.array(*(F.lit(s) for s in stop)))
    both = left.withColumnRenamed("text", "lt").join(right.withColumnRenamed("text", "rt"), "key")
    return both.select("key", F.size(F.array_intersect(words("lt"), words("rt"))).alias("shared"))


def verdicts(spans: DataFrame, reviews: DataFrame) -> DataFrame:
    """key and status of each span: missing without a review, ambiguous with several, else by its verdict."""
    n = spans.join(reviews, "key", "left").groupBy("key").agg(F.count("verdict").alias("n"), F.min("verdict").alias("verdict"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(F.col("verdict").isin("exact", "equivalent"), "verified").otherwise("mismatch")
    return n.select("key", status.alias("status"))


def bijection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Labels that don't match one to one: label, n_left, n_right."""
    l, r = left.groupBy("label").agg(F.count(F.lit(1)).alias("n_left")), right.groupBy("label").agg(F.count(F.lit(1)).alias("n_right"))
    both = l.join(r, "label", "full_outer").na.fill(0, ["n_left", "n_right"])
    return both.where("n_left <> 1 or n_right <> 1")


def unique_ranges(targets: DataFrame, sections: DataFrame) -> DataFrame:
    """target and section with the same (start, end), if only one section has that range."""
    only = sections.groupBy("start", "end").agg(F.min("section").alias("section"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return targets.join(only, ["start", "end"]).select("target", "section")


def accounted(source: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids that don't appear exactly once among the entries, and entries of foreign ids: id, n, foreign."""
    n = entries.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = source.select("id", F.lit(True).alias("own")).join(n, "id", "full_outer")
    return both.where("own is null or n is null or n <> 1").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.col("own").isNull().alias("foreign"))


def label_projection(blocks: DataFrame, verified: DataFrame) -> DataFrame:
    """Block and label for documents of which every uniquely labelled block is verified; partial ones project nothing."""
    once = blocks.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "label"))).where("k = 1").drop("k")
    joined = once.join(verified.select("doc_id", "label", F.lit(True).alias("ok")), ["doc_id", "label"], "left")
    whole = F.bool_and(F.coalesce("ok", F.lit(False))).over(Window.partitionBy("doc_id"))
    return joined.withColumn("whole", whole).where("whole").select("doc_id", "block", "label")


def grid_overlaps(cells: DataFrame) -> DataFrame:
    """Grid points (doc_id, row, col) that two cells (row, col, rows, cols) cover."""
    span = lambda a, n: F.sequence(F.col(a), F.col(a) + F.col(n) - 1)
    points = cells.select("doc_id", F.explode(span("row", "rows")).alias("r"), "col", "cols").select("doc_id", "r", F.explode(span("col", "cols")).alias("c"))
    return points.groupBy("doc_id", "r", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def running_headers(items: DataFrame, near: float = 10.0) -> DataFrame:
    """Items (doc_id, key, page, y, kind) of titles that repeat at the same height on other pages: doc_id, key, pages.

    Instead of joining items with each other, heights are cut into runs whose neighbours lie within ``near``.
    """
    w = Window.partitionBy("doc_id", "key").orderBy("y", "page")
    runs = items.withColumn("new", (F.col("y") - F.coalesce(F.lag("y").over(w), F.lit(-1e9)) > near).cast("int"))
    numbered = runs.withColumn("run", F.sum("new").over(w))
    pages = numbered.groupBy("doc_id", "key", "run").agg(F.count_distinct("page").alias("pages")).where("pages >= 2")
    return pages.groupBy("doc_id", "key").agg(F.max("pages").alias("pages"))


def box_errors(items: DataFrame) -> DataFrame:
    """Items (id, box) with why their box isn't valid: four finite numbers from 0 to 1000 in order."""
    n, x = F.size("box"), lambda i: F.try_element_at("box", F.lit(i))
    error = F.when(n != 4, "length").when(F.exists("box", lambda v: v.isNull() | F.isnan(v)), "not_finite")
    error = error.when(F.exists("box", lambda v: (v < 0) | (v > 1000)), "out_of_range").when((x(1) > x(3)) | (x(2) > x(4)), "order")
    return items.select("id", error.alias("error")).where("error is not null")


def label_anomalies(equations: DataFrame) -> DataFrame:
    """doc_id, duplicates, regressions and gaps of integer labels in order, for documents with two equations or more."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    rows = equations.withColumn("previous", F.lag("label").over(w)).withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("ordinal")) > 1)
    return (
        rows.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or("again").alias("duplicates"), F.bool_or(F.coalesce(F.col("label") < F.col("previous"), F.lit(False))).alias("regressions"), F.bool_or(F.coalesce(F.col("label") > F.col("previous") + 1, F.lit(False))).alias("gaps"))
        .where("n >= 2").drop("n")
    )
