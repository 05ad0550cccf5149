"""Parser queries over ``pages`` and ``documents``; their rows are tested against fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.parse import frames
from tessera.plans.registry import query, table


def pages(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("html").alias("format"), F.col("html").alias("text"))


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lit("markdown").alias("format"), "text")


def papers(spark, d):
    """The pages, each with metadata, a table, an image and a note of its own in front."""
    own = F.col("doc_id").cast("string")
    parts = [
        '<meta name="keywords" content="alpha, term ', own, '; - "><meta name="citation_author" content="A. ', own, '"><meta name="citation_author_institution" content="I, 1">',
        '<meta name="citation_author_orcid" content="https://orcid.org/0000-0001-2345-678X"><p>text<a href="#fn1">1</a> <img src="a/', own, '.png"><img src="data:x"></p>',
        '<table><tr><th>h</th><td colspan="2">', own, '</td></tr></table><p id="fn1">note ', own, "</p>",
    ]
    front = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return pages(spark, d).withColumn("text", F.concat(front, "text"))


@query("mp5_html_sections")
def mp5_html_sections(spark, d):
    return frames.sections(pages(spark, d))


@query("mp7_stated_terms", """SELECT page_id AS doc_id, o AS ordinal, CASE o WHEN 0 THEN 'alpha' ELSE 'term ' || page_id END AS term, NULL::VARCHAR AS error FROM pages, (VALUES (0), (1)) t(o)""")
def mp7_stated_terms(spark, d):
    return frames.terms(papers(spark, d))


@query("mp11_html_lists")
def mp11_html_lists(spark, d):
    return frames.list_items(pages(spark, d))


@query("mp12_html_tables", """SELECT page_id AS doc_id, 0 AS "table", 0 AS "row", o AS col, 1 AS "rows", o + 1 AS cols, o = 0 AS header, CASE o WHEN 0 THEN 'h' ELSE page_id::VARCHAR END AS text, NULL::VARCHAR AS error FROM pages, (VALUES (0), (1)) t(o)""")
def mp12_html_tables(spark, d):
    return frames.table_cells(papers(spark, d))


@query("mp19_dependencies", """SELECT page_id AS doc_id, 0 AS ordinal, 'img' AS element, 'src' AS attribute, 'a/' || page_id || '.png' AS address, NULL::VARCHAR AS error FROM pages""")
def mp19_dependencies(spark, d):
    return frames.dependencies(papers(spark, d))


@query("mp2_markdown_sections")
def mp2_markdown_sections(spark, d):
    return frames.sections(documents(spark, d))


@query("mp3_formulas")
def mp3_formulas(spark, d):
    return frames.formulas(documents(spark, d))


@query("mp8_markdown_blocks")
def mp8_markdown_blocks(spark, d):
    return frames.blocks(documents(spark, d))


@query("mp4_tex_sections")
def mp4_tex_sections(spark, d):
    return frames.sections(documents(spark, d).withColumn("format", F.lit("tex")))


@query("mp9_tex_blocks")
def mp9_tex_blocks(spark, d):
    return frames.blocks(documents(spark, d).withColumn("format", F.lit("tex")))


@query("mp10_html_blocks")
def mp10_html_blocks(spark, d):
    return frames.blocks(pages(spark, d))


@query("mp15_authors", """SELECT page_id AS doc_id, 0 AS ordinal, 'A. ' || page_id AS name, '0000-0001-2345-678X' AS orcid, 'I, 1' AS affiliations, NULL::VARCHAR AS error FROM pages""")
def mp15_authors(spark, d):
    return frames.authors(papers(spark, d)).withColumn("affiliations", F.array_join("affiliations", "; "))


@query("mp16_notes", """SELECT page_id AS doc_id, 'fn1' AS anchor, '1' AS marker, 'note ' || page_id AS body, NULL::VARCHAR AS error FROM pages""")
def mp16_notes(spark, d):
    return frames.notes(papers(spark, d))


@query("mp21_inline_segments")
def mp21_inline_segments(spark, d):
    return frames.segments(pages(spark, d))
