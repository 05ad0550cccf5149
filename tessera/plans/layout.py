"""Queries of recognised pages, bundles and the marks of rendered papers, over pages made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import finish, validators
from tessera.operators import ocr as O
from tessera.parse import frames
from tessera.parse import ocr as items
from tessera.plans.registry import query, table


def marked_up(spark, d, *cases: str):
    """A page for each of ``pages``, of the case that its id selects; # stands for the id."""
    i = F.col("page_id")
    text = F.element_at(F.array(*map(F.lit, cases)), (i % len(cases) + 1).cast("int"))
    return table(spark, d, "pages").select(i.alias("doc_id"), F.lit("html").alias("format"), F.replace(text, F.lit("#"), i.cast("string")).alias("text"))


@query("mp14_heading_roles", """WITH c(m, o, title, level, role, problem) AS (VALUES (0, 0, 'Title #', 1, NULL, NULL), (0, 1, 'Abstract', 2, 'abstract', NULL), (0, 2, 'Part', 2, NULL, NULL), (0, 3, 'Thanks', 3, 'acknowledgements', NULL),
(1, 0, 'Keywords', 6, 'classification', NULL), (1, 1, 'A', NULL, NULL, 'several_titles'), (1, 2, 'B', NULL, NULL, 'several_titles'), (2, 0, 'Part', 2, NULL, NULL), (2, 1, 'Abstract', NULL, NULL, 'abstract_not_in_front'))
SELECT page_id AS doc_id, o AS ordinal, replace(title, '#', page_id::VARCHAR) AS title, level, role, problem, NULL::VARCHAR AS error FROM pages JOIN c ON page_id % 3 = m""")
def mp14_heading_roles(spark, d):
    return frames.heading_roles(marked_up(
        spark, d,
        '<h1>Title #</h1><div class="ltx_abstract"><h6 class="ltx_title ltx_title_abstract">Abstract</h6><p>x</p></div><section><h2>Part</h2><div class="ltx_acknowledgements"><h6>Thanks</h6></div></section>',
        '<div class="ltx_keywords"><h6>Keywords</h6></div><div class="ltx_abstract"><h6>A</h6><h6>B</h6></div>',
        '<section><h2>Part</h2><h6 class="ltx_title_abstract">Abstract</h6></section>',
    ))


@query("mp22_equations", """WITH c(m, o, tex, label) AS (VALUES (0, 0, 'a_# b', '1'), (1, 0, 'a', '1'), (1, 1, 'b c_#', '2'), (2, 0, 'a', ''), (2, 1, 'b', ''))
SELECT page_id AS doc_id, o AS ordinal, replace(tex, '#', page_id::VARCHAR) AS tex, label, NULL::VARCHAR AS error FROM pages JOIN c ON page_id % 3 = m""")
def mp22_equations(spark, d):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    tex, tag = '<math alttext="{}"></math>'.format, '<span class="ltx_tag ltx_tag_equation">({})</span>'.format
    return frames.equations(marked_up(
        spark, d,
        f"<table>{row(tex('a_#'))}{row(tex('b'), tag(1))}</table>",
        f"<table>{row(tex('a'), tag(1))}{row(tex('b'), tag(2))}{row(tex('c_#'))}</table><table><tr><td>none</td></tr></table>",
        f"<table>{row(tex('a'))}{row(tex('b'))}</table>",
    ))


@query("mp23_captions", """WITH c(m, o, kind, text, placement, alignment, problem) AS (VALUES (0, 0, 'figure', 'Figure #', 'after_content', 'center', NULL), (1, 0, 'table', 'Table #', 'embedded', NULL, NULL), (1, 1, 'figure', 'first', 'before_content', 'start', NULL),
(2, 0, 'figure', 'x', NULL, NULL, 'conflicting_alignment'), (2, 1, 'figure', 'y', NULL, NULL, 'between_content'))
SELECT page_id AS doc_id, o AS ordinal, kind, replace(text, '#', page_id::VARCHAR) AS text, placement, alignment, problem, NULL::VARCHAR AS error FROM pages JOIN c ON page_id % 3 = m""")
def mp23_captions(spark, d):
    return frames.captions(marked_up(
        spark, d,
        '<figure><img src="a.png"><figcaption class="ltx_caption ltx_centering">Figure #</figcaption></figure>',
        '<table><caption>Table #</caption><tr><td>1</td></tr></table><figure><figcaption style="color: red; text-align: start !important">first</figcaption><img src="b.png"></figure>',
        '<figure><img src="a.png"><figcaption class="ltx_centering" style="text-align: end">x</figcaption></figure><figure><img src="a.png"><figcaption>y</figcaption><img src="b.png"></figure>',
    ))


@query("mp13_figure_panels", """WITH c(m, f, p, layout, r, k, target, w, h, ratio, problem) AS (VALUES (0, 0, 0, 'single', NULL, NULL, 'a#.png', 640, 480, '4:3', NULL),
(1, 0, 0, 'flex', 0, 0, 'a.png', NULL, NULL, NULL, NULL), (1, 0, 1, 'flex', 0, 1, 'b.png', NULL, NULL, NULL, NULL), (1, 0, 2, 'flex', 1, 0, 'c.png', NULL, NULL, NULL, NULL),
(2, 0, 0, 'neutral', NULL, NULL, 'a.png', NULL, NULL, NULL, NULL), (2, 0, 1, 'neutral', NULL, NULL, 'b.png', 10, NULL, NULL, NULL), (2, 1, 0, 'neutral', NULL, NULL, 'c.png', NULL, NULL, NULL, 'bad_cell'))
SELECT page_id AS doc_id, f AS figure, p AS panel, layout, r AS "row", k AS col, replace(target, '#', page_id::VARCHAR) AS target, w AS width, h AS height, ratio, problem, NULL::VARCHAR AS error FROM pages JOIN c ON page_id % 3 = m""")
def mp13_figure_panels(spark, d):
    cell = '<div class="ltx_flex_cell ltx_flex_size_2"><img src="{}.png"></div>'.format
    return frames.panels(marked_up(
        spark, d,
        '<figure><img src="a#.png" width="640" height="480px"></figure>',
        f'<figure><div class="ltx_flex_figure">{cell("a")}{cell("b")}<div class="ltx_flex_break"></div>{cell("c")}</div></figure>',
        '<figure><img src="a.png"><img src="b.png" width="10"></figure><figure><div class="ltx_flex_figure"><p><img src="c.png"></p></div></figure>',
    ))


@query("mp24_loose_media", """WITH c(m, o, element, target, alt) AS (VALUES (0, 0, 'img', 'i#.png', 'one'), (0, 1, 'svg', 'inline:svg', ''), (1, 0, 'object', 'o.svg', ''))
SELECT page_id AS doc_id, o AS ordinal, element, replace(target, '#', page_id::VARCHAR) AS target, alt, NULL::VARCHAR AS error FROM pages JOIN c ON page_id % 3 = m""")
def mp24_loose_media(spark, d):
    return frames.loose_media(marked_up(
        spark, d,
        '<ul><li><img src="i#.png" alt="one"></li></ul><table><tr><td><svg><path d="M0 0"/></svg></td></tr></table><p><img src="shown.png"></p>',
        '<h2>t <object data="o.svg"><img src="in.png"></object></h2>', '<figure><table><tr><td><img src="f.png"></td></tr></table></figure>',
    ))


@query("mp17_drawings", """SELECT page_id AS doc_id, 0 AS ordinal, 3 AS start, 3 + length(s) AS "end", '<svg viewBox="0 0 1 1" xmlns="http://www.w3.org/2000/svg"><path d="M' || page_id || '"/></svg>' AS svg, NULL::VARCHAR AS error
FROM (SELECT page_id, '<svg viewBox="0 0 1 1" onload="f()"><script>x</script><path d="M' || page_id || '"/></svg>' AS s FROM pages WHERE page_id % 2 = 0)""")
def mp17_drawings(spark, d):
    return frames.drawings(marked_up(spark, d, '<p><svg viewBox="0 0 1 1" onload="f()"><script>x</script><path d="M#"/></svg></p>', "<p><svg><g></p>"))


#: An order is a page of its customer: line 1 is the title, the others are images; the header says the day.
LABELS = """h AS (SELECT o_custkey AS doc_id, o_orderkey AS page, 'Day ' || strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders),
n AS (SELECT doc_id, text FROM h GROUP BY ALL HAVING count(*) = 1),
i AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o, l_quantity::INT AS q, l_partkey % 100 AS x, l_partkey * 3 % 70 AS y FROM lineitem),
c AS (SELECT page, min(o) AS before FROM (SELECT * FROM i WHERE o > 1 AND x < 60 AND x + q > 10 AND 60 + y BETWEEN 90 AND 140 AND x + q <= 130) GROUP BY page HAVING count(*) = 1),
t AS (SELECT DISTINCT page FROM i WHERE o = 1)"""


@query("g2_title_labels", f"""WITH {LABELS} SELECT doc_id, page, before, text, [10.0, 20.0, 60.0, 90.0]::DOUBLE[] AS box FROM h JOIN n USING (doc_id, text) JOIN c USING (page) JOIN t USING (page)""")
def g2_title_labels(spark, d):
    num = lambda *v: F.array(*(x.cast("double") if not isinstance(x, int) else F.lit(float(x)) for x in v))
    o = table(spark, d, "orders")
    headers = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.lit(2000.0).alias("width"), F.lit(1000.0).alias("height"), num(20, 20, 120, 90).alias("box"), F.concat(F.lit(" Day "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("text"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x, y, q = F.col("l_partkey") % 100, F.col("l_partkey") * 3 % 70 + 60, F.round("l_quantity").cast("int")
    lines = table(spark, d, "lineitem").withColumn("ordinal", F.row_number().over(w)).join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    title = F.col("ordinal") == 1
    rows = lines.select(
        F.col("o_custkey").alias("doc_id"), F.col("l_orderkey").alias("page"), "ordinal", F.when(title, "text").otherwise("image").alias("type"), F.when(title, "A title").alias("text"), F.when(title, 1).alias("level"),
        F.when(title, num(130, 50, 900, 300)).otherwise(F.array(x.cast("double"), y.cast("double"), (x + q).cast("double"), (y + q).cast("double"))).alias("box"),
    )
    return O.title_labels(headers, rows)


@query("g3_page_texts", """WITH c AS (SELECT conv_id AS doc_id, turn, 'w' || conv_id || ' ' || turn AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT *, turn % 2 = 0 AND EXISTS (SELECT 1 FROM c y WHERE y.doc_id = c.doc_id AND y.turn = c.turn + 1) AS own FROM c)
SELECT DISTINCT doc_id, NULL::BIGINT AS item, NULL::VARCHAR AS text, 'other_text' AS error FROM p WHERE own AND doc_id % 7 = 0
UNION ALL SELECT doc_id, turn, t, NULL FROM p WHERE doc_id % 7 <> 0 AND (own OR turn % 2 = 1)""")
def g3_page_texts(spark, d):
    """Each even turn has taken the words of the odd one behind it, on the next page; every seventh conversation's items say something else."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.concat(F.lit("w"), F.col("conv_id").cast("string"), F.lit(" "), F.col("turn").cast("string")).alias("t"))
    c = c.withColumn("after", F.lead("t").over(Window.partitionBy("doc_id").orderBy("turn")))
    odd, box = F.col("turn") % 2 == 1, F.array(*map(F.lit, (10.0, 20.0, 30.0, 40.0)))
    line = lambda t, cross: F.struct(box.alias("box"), F.lit(None).cast("boolean").alias("starts_item"), F.array(F.struct(box.alias("box"), F.lit("text").alias("kind"), F.col(t).alias("content"), F.lit(cross).alias("cross"))).alias("spans"))
    merged = F.when(odd, F.array().cast(O.LINES)).when(F.col("after").isNull(), F.array(line("t", False))).otherwise(F.array(line("t", False), line("after", True)))
    block = ["doc_id", F.col("turn").alias("page"), F.lit("text").alias("kind"), box.alias("box"), F.lit(None).cast("int").alias("index")]
    blocks = c.select(*block, F.lit(0).alias("ordinal"), odd.alias("deleted"), merged.alias("lines"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"))
    said = F.when((F.col("doc_id") % 7 == 0), "other").when(odd, "").otherwise(F.concat_ws(" ", "t", "after"))
    rows = c.select("doc_id", F.col("turn").alias("item"), F.col("turn").alias("page"), F.array(*map(F.lit, (100.0, 100.0, 300.0, 200.0))).alias("box"), said.alias("text"))
    return O.page_texts(blocks, c.select(*block, F.array(line("t", False)).alias("lines")), rows)


ITEMS = """i AS (SELECT conv_id AS doc_id, turn AS ordinal, turn + 1 AS page, CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'equation' WHEN 2 THEN 'header' ELSE 'image' END AS kind, conv_id % 2 = 0 AS pic FROM conversations),
e AS (SELECT doc_id, ordinal, page, kind, CASE WHEN kind = 'header' THEN 'excluded' WHEN kind = 'image' AND NOT pic THEN 'unavailable' ELSE 'included' END AS status,
  CASE kind WHEN 'header' THEN '' WHEN 'text' THEN '<h2 id="' || s || '">a * b &lt; <math alttext="x_' || doc_id || '"></math></h2>' WHEN 'equation' THEN '<math id="' || s || '" display="block" alttext="y"></math>'
    ELSE CASE WHEN pic THEN '<figure id="' || s || '"><img src="assets/p.png" alt=""><figcaption>cap</figcaption></figure>' ELSE '<p id="' || s || '">cap</p>' END END AS html
  FROM (SELECT *, 'pdf-p' || page || '-b' || ordinal || '-n0' AS s FROM i))"""


def _items(spark, d):
    kind = F.col("turn") % 4
    item = (
        F.when(kind == 0, F.concat(F.lit(r'{"type": "text", "text_level": 2, "text": "a \\* b < $x_'), F.col("conv_id").cast("string"), F.lit('$"}')))
        .when(kind == 1, '{"type": "equation", "text": "$$ y $$"}').when(kind == 2, '{"type": "header", "text": "h"}').otherwise('{"type": "image", "img_path": "p", "image_caption": ["cap"]}')
    )
    images = F.when(F.col("conv_id") % 2 == 0, F.create_map(F.lit("p"), F.lit("assets/p.png"))).otherwise(F.create_map().cast("map<string,string>"))
    return items.render_items(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), (F.col("turn") + 1).alias("page"), item.alias("item"), images.alias("images")))


@query("mp25_item_html", f"WITH {ITEMS} SELECT doc_id, ordinal, page, kind, status, html FROM e")
def mp25_item_html(spark, d):
    return _items(spark, d).drop("source_ids", "notes")


@query("sc11_page_import", f"""WITH {ITEMS} SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"></head><body>' || chr(10) || coalesce(string_agg(html, chr(10) ORDER BY ordinal) FILTER (html <> ''), '') || chr(10) || '</body></html>' || chr(10) AS html, count(*) AS entries
FROM e GROUP BY doc_id""")
def sc11_page_import(spark, d):
    return items.assembled(_items(spark, d))


@query("sc11_page_status", f"""WITH {ITEMS} SELECT doc_id, page, 'parsed' AS stated, CASE WHEN status = 'excluded' AND doc_id % 3 = 0 THEN 'unavailable' WHEN status = 'excluded' THEN 'empty' WHEN status = 'unavailable' THEN 'partial' ELSE 'parsed' END AS status FROM e""")
def sc11_page_status(spark, d):
    """Pages of headers only are empty, or unavailable where an entry was expected."""
    e = _items(spark, d)
    pages = e.select("doc_id", "page", F.lit(1).alias("size"), F.when((F.col("status") != "excluded") | (F.col("doc_id") % 3 == 0), 1).otherwise(0).alias("expected"), F.lit("parsed").alias("status"))
    return O.page_status(pages, e)


@query("sc15_bundle_errors", """WITH c AS (SELECT conv_id AS doc_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT doc_id, 'page_gap' AS rule, (n - 1)::VARCHAR AS subject FROM c WHERE doc_id % 5 = 0 AND turn = 0 AND n > 1
UNION ALL SELECT doc_id, 'box', turn::VARCHAR FROM c WHERE turn % 6 = 5 UNION ALL SELECT doc_id, 'anchor_again', 'twice' FROM c WHERE doc_id % 7 = 0 AND turn % 8 = 0 GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT doc_id, 'anchor_not_in_source', 'b' || turn FROM c WHERE doc_id % 11 = 0 AND turn = 1 AND NOT (doc_id % 7 = 0 AND turn % 8 = 0)
UNION ALL SELECT doc_id, 'file_missing', 'f' || turn FROM c WHERE text IS NULL OR turn % 9 = 4
UNION ALL SELECT doc_id, 'file_differs', 'f' || turn FROM c WHERE text IS NOT NULL AND turn % 9 <> 4 AND turn % 9 = 3
UNION ALL SELECT doc_id, 'image_not_shown', 'f' || turn FROM c WHERE turn = 2 AND doc_id % 2 = 0 UNION ALL SELECT doc_id, 'image_not_bound', 'g' FROM c WHERE turn = 0 AND doc_id % 13 = 0""")
def sc15_bundle_errors(spark, d):
    """A page, an entry and a file for each turn, with faults here and there."""
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "doc_id")
    i, t = F.col("doc_id"), F.col("turn")
    name = lambda p: F.concat(F.lit(p), t.cast("string"))
    page = (t + 1).alias("page")
    many = F.max("turn").over(Window.partitionBy("doc_id"))
    pages = c.withColumn("many", many).where((i % 5 != 0) | (t != 0) | (F.col("many") == 0)).select("doc_id", page, F.lit(1).alias("size"), F.lit(1).alias("expected"), F.lit("parsed").alias("status"))
    box = F.array(F.lit(1.0), F.lit(1.0), F.when(t % 6 == 5, 0.5).otherwise(2.0), F.lit(2.0))
    anchor = F.when((i % 7 == 0) & (t % 8 == 0), "twice").otherwise(name("b"))
    entries = c.select("doc_id", F.col("turn").alias("ordinal"), page, box.alias("box"), F.lit("included").alias("status"), F.array(anchor).alias("source_ids"))
    anchors = c.where((i % 11 != 0) | (t != 1) | ((i % 7 == 0) & (t % 8 == 0))).select("doc_id", anchor.alias("id")).distinct()
    text = F.col("text").cast("binary")
    files = c.select(
        "doc_id", F.when(t == 2, "resource").otherwise("evidence").alias("role"), name("f").alias("path"), F.octet_length("text").alias("size"), F.when(t % 9 == 3, "0").otherwise(F.sha2(text, 256)).alias("sha256"),
        (t == 2).alias("rendered"), F.when(t % 9 != 4, text).alias("payload"),
    )
    images = c.where((t == 2) & (i % 2 != 0)).select("doc_id", F.lit("f2").alias("src")).unionByName(c.where((t == 0) & (i % 13 == 0)).select("doc_id", F.lit("g").alias("src")))
    return O.bundle_errors(pages, entries, files, anchors, images)


@query("v7_note_errors", """WITH c AS (SELECT conv_id AS doc_id, turn, text, text[1 : 2] AS m FROM conversations WHERE length(text) >= 4)
, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS o, row_number() OVER (PARTITION BY doc_id, turn // 2 ORDER BY turn) AS r FROM c)
SELECT doc_id, o AS ordinal, 'note_id' AS rule FROM n WHERE doc_id % 3 = 0 AND r > 1
UNION ALL SELECT doc_id, o, 'owner' FROM n WHERE doc_id % 5 = 0 AND turn = 1
UNION ALL SELECT doc_id, o, 'anchor' FROM n WHERE NOT (doc_id % 5 = 0 AND turn = 1) AND doc_id % 4 = 0 AND text[3 : 4] <> m
UNION ALL SELECT doc_id, o, 'marker' FROM n WHERE trim(m) = ''""")
def v7_note_errors(spark, d):
    """Each turn is a block with a note on its first two characters, or where the note says."""
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "doc_id").where("length(text) >= 4")
    i, t = F.col("doc_id"), F.col("turn")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn")) - 1
    start = F.when(i % 4 == 0, 2).otherwise(0)
    own = t.cast("string")
    notes = c.select(
        "doc_id", nth.alias("ordinal"), F.when(i % 3 == 0, F.floor(t / 2).cast("string")).otherwise(own).alias("note_id"), F.lit("").alias("source_id"), F.substring("text", 1, 2).alias("marker"), F.lit("body").alias("body"),
        F.when((i % 5 == 0) & (t == 1), "none").otherwise(own).alias("block_id"), F.lit(0).alias("place"), start.alias("start"), (start + 2).alias("end"),
    )
    return O.note_errors(notes, c.select("doc_id", own.alias("block_id"), t.alias("b_ordinal"), F.lit(0).alias("place"), "text"))


@query("v8_view_errors", """WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o, * FROM lineitem)
SELECT doc_id, o::VARCHAR AS block_id, 'level_of_role' AS rule FROM l WHERE l_partkey % 10 = 0 AND o % 2 = 0 UNION ALL SELECT doc_id, o::VARCHAR, 'role_of_heading' FROM l WHERE l_partkey % 10 = 0 AND l_suppkey % 2 = 1
UNION ALL SELECT doc_id, o::VARCHAR, 'text_of_view' FROM l WHERE l_quantity > 45 UNION ALL SELECT doc_id, o::VARCHAR, 'mark' FROM l WHERE o % 5 = 4
UNION ALL SELECT doc_id, o::VARCHAR, 'cell' FROM l WHERE l_suppkey % 9 = 0 UNION ALL SELECT doc_id, o::VARCHAR, 'overlap' FROM l WHERE l_suppkey % 9 <> 0 AND l_partkey % 8 = 0""")
def v8_view_errors(spark, d):
    """Each line item is a block with a view, a mark and two cells, with faults here and there."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = table(spark, d, "lineitem").withColumn("o", F.row_number().over(w))
    part, supplier, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("o")
    key = [F.col("l_orderkey").alias("doc_id"), o.cast("string").alias("block_id")]
    roles = F.when(part % 10 == 0, F.array(F.lit("abstract"))).otherwise(F.array().cast("array<string>"))
    blocks = x.select(*key, F.when(supplier % 2 == 1, "paragraph").otherwise("heading").alias("kind"), F.when(o % 2 == 0, 3).otherwise(2).alias("level"), roles.alias("roles"), F.lit(2).alias("height"), F.lit(3).alias("width"))
    views = x.select(*key, F.lit("text").alias("field"), F.lit(0).alias("place"), F.col("l_returnflag").alias("text"), F.when(F.col("l_quantity") > 45, "?").otherwise(F.col("l_returnflag")).alias("plain"))
    marks = x.select(*key, F.lit("text").alias("field"), F.lit(0).alias("place"), F.lit(0).alias("start"), F.when(o % 5 == 4, 2).otherwise(1).alias("end"))
    cell = lambda row, rows, cols: F.struct(F.lit(row).alias("row"), F.lit(0).alias("col"), F.lit(rows).alias("rows") if isinstance(rows, int) else rows.alias("rows"), F.lit(cols).alias("cols") if isinstance(cols, int) else cols.alias("cols"))
    both = F.array(cell(0, F.when(part % 8 == 0, 2).otherwise(1), 1), cell(1, 1, F.when(supplier % 9 == 0, 4).otherwise(3)))
    cells = x.select(*key, F.explode(both).alias("c")).select("doc_id", "block_id", "c.*")
    return O.view_errors(blocks, views, marks, cells)


#: Turns as blocks: every third is a heading, every second has an id, of which some are the same.
FINISHED = """b AS (SELECT conv_id AS doc_id, turn AS o, 't' || turn AS t, CASE WHEN turn % 3 = 1 THEN 1 + (conv_id + turn // 3) % 3 END AS level, CASE WHEN turn % 2 = 0 THEN '' WHEN conv_id % 4 = 0 THEN 'same' ELSE 'id' || turn END AS sid FROM conversations),
n AS (SELECT doc_id, max(o) + 1 AS n FROM b GROUP BY 1),
h AS (SELECT doc_id, o, level, t AS title, 'sec-' || left(sha256('{"level":' || level || ',"ordinal":' || o || ',"source":"s' || doc_id || '","title":"' || t || '"}'), 20) AS id FROM b WHERE level IS NOT NULL
  UNION ALL SELECT doc_id, 0, 1, 'Document', 'sec-' || left(sha256('{"role":"synthetic-document-section","source":"s' || doc_id || '"}'), 20) FROM n),
e AS (SELECT h.*, least(n, coalesce((SELECT min(x.o) FROM h x WHERE x.doc_id = h.doc_id AND x.o > h.o AND x.level <= h.level), n)) AS stop FROM h JOIN n USING (doc_id)),
k AS (SELECT b.doc_id, b.o, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS kind, sid,
  'block-' || left(sha256('{"kind":"' || CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END || '","ordinal":' || o || ',"payload":"' || t || '","source":"s' || doc_id || '","source_id":"' || sid || '"}'), 24) AS block_id FROM b)"""


def _blocks(spark, d):
    i, t = F.col("conv_id"), F.col("turn")
    level = F.when(t % 3 == 1, (i + F.floor(t / 3)) % 3 + 1).cast("int")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    source_id = F.when(t % 2 == 0, "").when(i % 4 == 0, "same").otherwise(name("id", t))
    return table(spark, d, "conversations").select(i.alias("doc_id"), name("s", i).alias("source"), t.alias("ordinal"), F.when(level.isNull(), "paragraph").otherwise("heading").alias("kind"), level.alias("level"), name("t", t).alias("text"), name("t", t).alias("payload"), source_id.alias("source_id"))


@query("mp18_sections", f"""WITH {FINISHED} SELECT doc_id, id AS section_id, title, level, o AS first, stop AS last, (SELECT string_agg(a.id, '/' ORDER BY a.o) FROM e a WHERE a.doc_id = e.doc_id AND a.o <= e.o AND a.stop > e.o) AS path FROM e""")
def mp18_sections(spark, d):
    return finish.section_tree(_blocks(spark, d)).withColumn("path", F.array_join("path", "/"))


@query("mp18_blocks", f"""WITH {FINISHED} SELECT k.doc_id, k.o AS ordinal, kind, block_id, sid AS source_id, string_agg(e.id, '/' ORDER BY e.o) AS path FROM k JOIN e ON e.doc_id = k.doc_id AND e.o <= k.o AND e.stop > k.o GROUP BY ALL""")
def mp18_blocks(spark, d):
    b = _blocks(spark, d)
    return finish.with_identity(b, finish.section_tree(b)).withColumn("path", F.array_join("path", "/"))


@query("mp18_targets", f"""WITH {FINISHED}, u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sid) AS c FROM k WHERE sid <> '')
SELECT u.doc_id, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.o) - 1 AS target, sid AS alias, '#' || sid AS selector, CASE kind WHEN 'heading' THEN 'section' ELSE kind END AS kind, block_id, u.o AS first,
  CASE kind WHEN 'heading' THEN stop ELSE u.o + 1 END AS last, CASE kind WHEN 'heading' THEN id ELSE '' END AS section_id FROM u LEFT JOIN e ON e.doc_id = u.doc_id AND e.o = u.o WHERE c = 1""")
def mp18_targets(spark, d):
    """Targets of the documents whose targets are sound; all are, as they come from the tree."""
    b = _blocks(spark, d)
    tree = finish.section_tree(b)
    whole = finish.with_identity(b, tree)
    targets = finish.target_manifest(whole, tree)
    errors = validators.target_errors(targets, whole.select("doc_id", "block_id", "ordinal", "kind"), tree.select("doc_id", "section_id", "first", "last"))
    return finish.admitted(targets, errors)[0].drop("panels")
