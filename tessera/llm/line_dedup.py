"""Line dedup by range-partitioned hashes, with keep bitmaps as the result.

Every line becomes a row (128-bit hash of its key, 128-bit key of its document,
position). The rows are partitioned by ranges of hash and document, and sorted
by them and by position within; a pass over each sorted range tells the first
occurrence in a document from the others. As a range may end inside a hash, a
line that most documents hold is spread over as many ranges as its rows need.
First occurrences are counted per hash, one row a range and hash, and what is
returned is, per document, a compressed bitmap of the lines that stay: a map
of its words, without those that are all ones. No text moves with the hashes.

Only DataFrame functions are used. Defined results: null and empty texts are
one empty line, whose key is empty and never counted; repeated rows count as
documents of their own; null ids are kept; other columns are ignored (or kept,
in ``dedup_lines``); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm.common import LOWER, UPPER, WHITE, fresh, hot_keys, lower_az, row_keys, spread_join, table

#: Keys of at least so many code points, in at least so many documents, lose their lines.
LEAST_CHARS, LEAST_DOCS = 1, 10
BITS = 63


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.btrim(lower_az(line), F.lit(WHITE))


def line_rows(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, k1, k2, position) of every line whose key is long enough; rows alike in id and text share (k1, k2)."""
    rows = docs.select(*row_keys("k1", "k2"), F.coalesce("text", F.lit("")).alias("t"))
    lines = rows.select("k1", "k2", F.posexplode(F.split("t", "\n", -1)).alias("position", "line"))
    keyed = lines.select("k1", "k2", "position", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "k1", "k2", "position")


def frequent_lines(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, n) of the hashes in the rows of ``line_rows`` that are found in enough documents.

    Of each document the stream through a sorted range counts the rows at the first position only.
    """
    order = ["h1", "h2", "k1", "k2"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "position")
    w = Window.partitionBy(*order).orderBy("position")
    first = ranged.withColumn("first", (F.first("position").over(w) == F.col("position")).cast("int"))
    return first.groupBy("h1", "h2").agg(F.sum("first").alias("n")).where(F.col("n") >= least_docs)


def keep_bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(k1, k2, bitmap): for each document that loses lines, a map of the words of its bitmap that aren't all ones.

    Bit b of word w is set if line w * 63 + b stays.
    """
    with scratch.owner() as made:
        rows = scratch.materialize(line_rows(docs, least_chars), "lines")
        often = scratch.materialize(frequent_lines(rows, least_docs), "often")
        hot = hot_keys(often, ["h1", "h2"], "n", rows.count())
        gone = spread_join(rows, often, ["h1", "h2"], hot, ["k1", "k2"]).select("k1", "k2", "position")
        words = gone.groupBy("k1", "k2", F.floor(F.col("position") / BITS).cast("int").alias("word")).agg(
            F.bitwise_not(F.bit_or(F.expr(f"shiftleft(1L, position % {BITS})"))).alias("bits")
        )
        bitmaps = words.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))
        out = scratch.materialize(bitmaps, "bitmaps")
        made.keep(out)
    return out


def _kept(lines: Column, bitmap: Column) -> Column:
    """The lines whose bit is set, joined again."""

    def stays(_, i):
        return F.coalesce(F.getbit(F.try_element_at(bitmap, F.floor(i / BITS).cast("int")), i % BITS), F.lit(1)) == 1

    return F.array_join(F.when(bitmap.isNull(), lines).otherwise(F.filter(lines, stays)), "\n")


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """All columns of ``docs``, and, under ``names``: the lines before, the lines dropped, and the text of those that stay."""
    k1, k2, bitmap = (fresh(docs, n) for n in ("k1", "k2", "bitmap"))
    maps = keep_bitmaps(docs, least_docs, least_chars).withColumnsRenamed({"k1": k1, "k2": k2, "bitmap": bitmap})
    joined = docs.select("*", *row_keys(k1, k2)).join(maps, [k1, k2], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    dropped = F.aggregate(F.map_values(bitmap), F.lit(0).cast("bigint"), lambda a, x: a + 64 - F.bit_count(x))
    total, gone, kept = names
    return joined.select(
        *docs.columns, F.size(lines).cast("long").alias(total), F.coalesce(dropped, F.lit(0).cast("bigint")).alias(gone), _kept(lines, F.col(bitmap)).alias(kept)
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; keys of one code point or more in ten documents or more."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the frequent lines; all documents stay, and n_chars follows the text."""
    names = tuple(fresh(docs, n) for n in ("n_lines", "n_dropped", "kept"))
    out = dedup_lines(docs, names=names)
    kept, gone = F.col(names[2]), F.col(names[1]) > 0
    changed = {"text": F.when(gone, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(gone, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)),
k AS (SELECT doc_id, i, line, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
often AS (SELECT key FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT k.*, o.key IS NOT NULL AS gone FROM k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
