"""Queries of checks, repairs and small parsers, over texts and records made from the driver's tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

from tessera.functions.arrow import redact_json
from tessera.operators import blocks as B
from tessera.operators import keywords
from tessera.operators import validators as V
from tessera.parse import frames, html, markdown, rewrite, tex
from tessera.plans.registry import query, table
from tessera.sources import containers

# Each order is a list of items of two lines each; line numbers, suppliers and sizes break some rules.
LISTS = """x AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ordinal, l_suppkey, l_partkey, l_linenumber FROM lineitem),
e AS (SELECT doc_id, ordinal, 'c' || (ordinal // 4) AS c, 'i' || (ordinal // 2) AS i, (ordinal % 4) // 2 AS idx, CASE WHEN l_partkey % 10 = 0 THEN 3 ELSE 2 END AS cnt, CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE ordinal % 2 END AS seg, 's' || (l_partkey % 50) AS src FROM x WHERE l_linenumber % 7 <> 3)"""


@query("v5_list_paths", f"""WITH {LISTS},
f AS (SELECT doc_id, c, i, min(ordinal) AS a, max(ordinal) AS b, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT doc_id, c, min(a) AS a, max(b) AS b, sum(n) AS n FROM f GROUP BY ALL),
ix AS (SELECT doc_id, c, idx, min(ordinal) AS a FROM e GROUP BY ALL),
cov AS (SELECT doc_id, c, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM ix GROUP BY ALL),
cnt AS (SELECT doc_id, c, min(cnt) AS lo, max(cnt) AS hi FROM e GROUP BY ALL),
icnt AS (SELECT doc_id, i, min(cnt) AS lo, max(cnt) AS hi, min(src) AS s1, max(src) AS s2 FROM e GROUP BY ALL),
own AS (SELECT doc_id, 'list' || c AS source, 'c:' || c AS owner FROM e UNION ALL SELECT doc_id, src, 'i:' || i FROM e),
seg AS (SELECT doc_id, i, seg, row_number() OVER (PARTITION BY doc_id, i ORDER BY ordinal) - 1 AS nth FROM e)
SELECT doc_id, 'gap_in_container' AS rule, c AS subject FROM k WHERE b - a + 1 <> n
UNION ALL SELECT doc_id, 'gap_in_item', i FROM f WHERE b - a + 1 <> n
UNION ALL SELECT doc_id, 'conflicting_container', c FROM cnt WHERE lo <> hi
UNION ALL SELECT doc_id, 'conflicting_item', i FROM icnt WHERE lo <> hi OR s1 <> s2
UNION ALL SELECT doc_id, 'owners_of_source', source FROM own GROUP BY doc_id, source HAVING count(DISTINCT owner) > 1
UNION ALL SELECT doc_id, 'items_covered', c FROM cov JOIN cnt USING (doc_id, c) WHERE cov.lo <> 0 OR cov.hi <> n - 1 OR cnt.hi <> n
UNION ALL SELECT DISTINCT doc_id, 'segments', i FROM seg WHERE seg <> nth""")
def v5_list_paths(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = table(spark, d, "lineitem").withColumn("ordinal", F.row_number().over(w) - 1).where("l_linenumber % 7 <> 3")
    o = F.col("ordinal")
    name = lambda p, k: F.concat(F.lit(p), F.floor(o / k).cast("string"))
    path = x.select(
        F.col("l_orderkey").alias("doc_id"), "ordinal", F.lit(0).alias("place"), F.lit(0).alias("depth"), name("c", 4).alias("container_id"), F.concat(F.lit("list"), name("c", 4)).alias("container_source"),
        name("i", 2).alias("item_id"), F.concat(F.lit("s"), (F.col("l_partkey") % 50).cast("string")).alias("item_source"), F.floor((o % 4) / 2).cast("int").alias("item_index"),
        F.when(F.col("l_partkey") % 10 == 0, 3).otherwise(2).alias("item_count"), F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(o % 2).alias("segment"), F.lit(True).alias("ordered"),
    )
    blocks = x.select(F.col("l_orderkey").alias("doc_id"), "ordinal", F.lit("paragraph").alias("kind"), F.lit("s").alias("section"), F.lit(0).alias("items"), F.lit(True).alias("ordered"))
    return V.list_path_errors(blocks, path)


TARGETS = """x AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS o, * FROM lineitem),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
t AS (SELECT doc_id, o AS target, 't' || (l_partkey % 40) AS alias, l_suppkey % 10 = 0 AS odd, CASE l_partkey % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'paragraph' ELSE 'table' END AS b_kind, o + 1 + (l_quantity >= 50)::INT AS last,
  CASE WHEN l_linenumber % 5 = 0 THEN 'note' ELSE CASE l_partkey % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'paragraph' ELSE 'table' END END AS kind, 't' || (l_suppkey % 40) AS panel, l_tax >= 0.08 AS paneled FROM x)"""


@query("v6_target_errors", f"""WITH {TARGETS}
SELECT doc_id, target, 'alias' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, alias ORDER BY target) AS r FROM t) WHERE r > 1
UNION ALL SELECT doc_id, target, 'selector' FROM t WHERE odd UNION ALL SELECT doc_id, target, 'kind' FROM t WHERE kind = 'note' UNION ALL SELECT doc_id, target, 'kind_of_block' FROM t WHERE kind <> b_kind
UNION ALL SELECT doc_id, target, 'range' FROM t JOIN n USING (doc_id) WHERE last > n UNION ALL SELECT doc_id, target, 'one_block' FROM t WHERE last <> target + 1
UNION ALL SELECT doc_id, target, 'panels' FROM t WHERE kind <> 'figure' AND paneled
UNION ALL SELECT doc_id, target, 'panel_again' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, panel ORDER BY target) AS r FROM t WHERE paneled) WHERE r > 1
UNION ALL SELECT doc_id, target, 'panel_alias' FROM t WHERE paneled AND EXISTS (SELECT 1 FROM t y WHERE y.doc_id = t.doc_id AND y.alias = t.panel)""")
def v6_target_errors(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = table(spark, d, "lineitem").withColumn("o", F.row_number().over(w) - 1)
    of = lambda c, k: F.concat(F.lit("t"), (F.col(c) % k).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("figure", "paragraph", "table"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    block = F.col("o").cast("string").alias("block_id")
    blocks = x.select(F.col("l_orderkey").alias("doc_id"), block, F.col("o").alias("ordinal"), kind.alias("kind"))
    targets = x.select(
        F.col("l_orderkey").alias("doc_id"), F.col("o").alias("target"), of("l_partkey", 40).alias("alias"), F.concat(F.when(F.col("l_suppkey") % 10 == 0, "").otherwise("#"), of("l_partkey", 40)).alias("selector"),
        F.when(F.col("l_linenumber") % 5 == 0, "note").otherwise(kind).alias("kind"), block, F.col("o").alias("first"), (F.col("o") + 1 + (F.col("l_quantity") >= 50).cast("int")).alias("last"), F.lit("").alias("section_id"),
        F.when(F.col("l_tax") >= 0.08, F.array(of("l_suppkey", 40))).otherwise(F.array().cast("array<string>")).alias("panels"),
    )
    none = spark.createDataFrame([], "doc_id long, section_id string, first int, last int")
    return V.target_errors(targets, blocks, none)


@query("v9_closed_contracts", """SELECT conv_id * 1000 + turn AS id, '$.extra' AS path, 'false' AS rule FROM conversations WHERE conv_id % 5 = 0
UNION ALL SELECT conv_id * 1000 + turn, '$.role', 'enum' FROM conversations WHERE role = 'system' UNION ALL SELECT conv_id * 1000 + turn, '$.turn', 'required' FROM conversations WHERE turn % 4 = 3""")
def v9_closed_contracts(spark, d):
    c = table(spark, d, "conversations")
    value = F.to_json(F.struct("role", F.when(F.col("turn") % 4 != 3, F.col("turn")).alias("turn"), F.when(F.col("conv_id") % 5 == 0, 1).alias("extra")))
    schema = {"type": "object", "required": ["role", "turn"], "additionalProperties": False, "properties": {"role": {"enum": ["user", "assistant"]}, "turn": {"type": "integer"}}}
    return V.schema_violations(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), value.alias("value")), schema)


@query("sx9_schema_violations", """SELECT event_id AS id, '$.k' AS path, 'range' AS rule FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50""")
def sx9_schema_violations(spark, d):
    return V.schema_violations(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("value")), {"type": "object", "properties": {"k": {"type": "integer", "maximum": 50}}})


@query("v10_digest_mismatches", "SELECT event_id AS id FROM events WHERE event_id % 9 = 0")
def v10_digest_mismatches(spark, d):
    i = F.col("event_id").cast("string")
    value = F.concat(F.lit('{ "b": '), i, F.lit(', "a": ["'), F.col("event_type"), F.lit('"]}'))
    digest = F.sha2(F.concat(F.lit('{"a":["'), F.col("event_type"), F.lit('"],"b":'), i, F.lit("}")).cast("binary"), 256)
    return V.digest_mismatches(table(spark, d, "events").select(F.col("event_id").alias("id"), value.alias("value"), F.when(F.col("event_id") % 9 == 0, F.reverse(digest)).otherwise(digest).alias("digest")))


@query("v11_revisions", """SELECT conv_id * 1000 + turn AS block_id, CASE WHEN turn % 5 = 4 THEN 'removed' WHEN role = 'system' THEN 'kind' ELSE 'anchor' END AS rule FROM conversations
WHERE turn % 5 = 4 OR role = 'system' OR (conv_id % 3 = 0 AND length(text) >= 4 AND text[1 : 3] <> text[2 : 4])""")
def v11_revisions(spark, d):
    c = table(spark, d, "conversations").where("length(text) >= 4").withColumn("block_id", F.col("conv_id") * 1000 + F.col("turn"))
    start = F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)
    anchor = F.array(F.struct(start.alias("s"), (start + 3).alias("e"), F.substring("text", 1, 3).alias("m")))
    after = c.where("turn % 5 <> 4").select("block_id", F.when(F.col("role") == "system", "list").otherwise(F.col("role")).alias("kind"), "text", anchor.alias("anchors"))
    return B.revision_errors(c.select("block_id", F.col("role").alias("kind")), after)


@query("st14_redact_value", """SELECT event_id, '{"Api-Key":"[REDACTED]","list":[{"ok":"' || event_type || '","password":"[REDACTED]"}],"note":"token=[REDACTED] and ' || event_id || '"}' AS value FROM events""")
def st14_redact_value(spark, d):
    value = F.concat(F.lit('{"note": "token=abc and '), F.col("event_id").cast("string"), F.lit('", "Api-Key": "k", "list": [{"password": {"x": 1}, "ok": "'), F.col("event_type"), F.lit('"}]}'))
    return table(spark, d, "events").select("event_id", redact_json(value).alias("value"))


@pandas_udf(StringType())
def _unwrapped(s: pd.Series) -> pd.Series:
    return s.map(tex.unwrap_pdfstring)


@query("st19_tex_titles", r"SELECT p_partkey, 'A ' || p_name || ' \texorpdfstring b ' || p_type AS title FROM part")
def st19_tex_titles(spark, d):
    title = F.concat(F.lit("A \\texorpdfstring {"), F.col("p_name"), F.lit("}\n {{x} y} \\texorpdfstring b \\texorpdfstring{"), F.col("p_type"), F.lit("}{z}"))
    return table(spark, d, "part").select("p_partkey", _unwrapped(title).alias("title"))


@pandas_udf(StringType())
def _inline(first: pd.Series, formula: pd.Series) -> pd.Series:
    def one(a: str, b: str) -> str:
        text, spans = B.inline([("text", f" {a}\n "), ("math", f" {b} "), ("text", "  end ")])
        return text + "|" + ",".join(f"{s}-{e}:{k}" for s, e, k in spans)

    return pd.Series([one(a, b) for a, b in zip(first, formula, strict=True)])


@query("st20_inline_payloads", """SELECT p_partkey, p_name || ' ' || p_type || ' end|0-' || (length(p_name) + 1) || ':text,' || (length(p_name) + 1) || '-' || (length(p_name) + 1 + length(p_type)) || ':math,'
  || (length(p_name) + 1 + length(p_type)) || '-' || (length(p_name) + 5 + length(p_type)) || ':text' AS inline FROM part""")
def st20_inline_payloads(spark, d):
    return table(spark, d, "part").select("p_partkey", _inline("p_name", "p_type").alias("inline"))


@pandas_udf(StringType())
def _key(brand: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([B.semantic_key({"size": int(n), "brand": b, "note": None}, {"size": 1, "note": None}) for b, n in zip(brand, size, strict=True)])


@query("st22_semantic_keys", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '"' || CASE WHEN p_size <> 1 THEN ',"size":' || p_size ELSE '' END || '}') AS key FROM part""")
def st22_semantic_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", _key("p_brand", "p_size").alias("key"))


@pandas_udf(StringType())
def _repaired(text: pd.Series, fragment: pd.Series) -> pd.Series:
    def one(t: str, f: str) -> str:
        try:
            return "|".join(f"{k}:{x}" for k, x in B.repair(t, f, [("math", "x"), ("text", "y")]))
        except B.NotUnique:
            return "not_unique"

    return pd.Series([one(t, f) for t, f in zip(text, fragment, strict=True)])


@query("st23_inline_repairs", """WITH f AS (SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS w FROM part)
SELECT p_partkey, CASE WHEN (length(p_name) - length(replace(p_name, w, ''))) = length(w) THEN 'math:x|text:y' || p_name[length(w) + 1 :] ELSE 'not_unique' END AS parts FROM f""")
def st23_inline_repairs(spark, d):
    return table(spark, d, "part").select("p_partkey", _repaired("p_name", F.substring_index("p_name", " ", 1)).alias("parts"))


@query("mp1_verified_sources", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'digest_mismatch' END AS error FROM documents WHERE text IS NOT NULL")
def mp1_verified_sources(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    good, bad = V.verified_sources(docs.select("doc_id", F.lit("markdown").alias("format"), "text", F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(digest).alias("digest")))
    return frames.sections(good).groupBy("doc_id").agg(F.max("error").alias("error")).unionByName(bad)


@query("mp20_heading_stream", "SELECT p_partkey AS doc_id, 1 AS line, 1 AS level, p_name AS title FROM part UNION ALL SELECT p_partkey, 5, 2, p_type FROM part")
def mp20_heading_stream(spark, d):
    text = F.concat(F.lit("# "), F.col("p_name"), F.lit(" #\n```\n# no\n```\n## "), F.col("p_type"), F.lit("\n    # no\n"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(i, *h) for i, t in batch.itertuples(index=False) for h in markdown.headings(t)], columns=["doc_id", "line", "level", "title"])

    return table(spark, d, "part").select("p_partkey", text.alias("text")).mapInPandas(run, "doc_id long, line int, level int, title string")


@query("w15_table_grids", """SELECT p_partkey AS doc_id, r, c, h, w, CASE k WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END AS text FROM part, (VALUES (0, 0, 0, 2, 1), (1, 0, 1, 1, 2), (2, 1, 1, 1, 1), (3, 1, 2, 1, 1)) g(k, r, c, h, w)""")
def w15_table_grids(spark, d):
    cell = lambda c, a="": F.concat(F.lit(f"<td{a}>"), F.col(c), F.lit("</td>"))
    text = F.concat(F.lit("<table><tr>"), cell("p_name", " rowspan=0"), cell("p_type", " colspan=2"), F.lit("</tr><tr>"), cell("p_brand"), cell("p_brand"), F.lit("</tr></table>"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(i, r, c, h, w, x) for i, t in batch.itertuples(index=False) for g in html.tables(t) for r, c, h, w, _, x in g], columns=["doc_id", "r", "c", "h", "w", "text"])

    return table(spark, d, "part").select("p_partkey", text.alias("text")).mapInPandas(run, "doc_id long, r int, c int, h int, w int, text string")


@pandas_udf(BinaryType())
def _book(s: pd.Series) -> pd.Series:
    def one(body: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
            z.writestr("o/p.opf", '<package xmlns="p"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
            z.writestr("o/a.xhtml", f"<p>{body}</p><script>no</script>")
        return out.getvalue()

    return s.map(one)


@query("sc10_books", "SELECT n_nationkey AS doc_id, 0 AS ordinal, 'o/a.xhtml' AS path, '<p>' || n_name || '</p>' AS html, NULL::VARCHAR AS error FROM nation")
def sc10_books(spark, d):
    return containers.books(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _book("n_name").alias("payload")))


@query("pf16_keyword_units", """WITH u AS (SELECT p_partkey AS doc_id, unnest(range(4)) AS ordinal, p_name, p_type FROM part)
SELECT doc_id, ordinal::INT AS ordinal, 's' || ordinal AS section_id, CASE ordinal WHEN 2 THEN 'Terms' ELSE 'Body' END AS title,
  CASE ordinal WHEN 0 THEN 'All of ' || p_type WHEN 2 THEN '' ELSE ' ' || chr(10) || 'rest ' || p_type END AS text, CASE WHEN ordinal < 3 THEN (ordinal + 1)::INT END AS page FROM u WHERE ordinal <> 1""")
def pf16_keyword_units(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type")
    texts = [("Body", F.concat(F.lit("All of "), "p_type")), ("Index terms", F.col("p_name")), ("Terms", F.concat(F.lit("- "), F.col("p_name"), F.lit("\n* Other one\n"))), ("Body", F.concat(F.lit("Keywords: "), F.col("p_name"), F.lit("; other one\nrest "), F.col("p_type")))]
    each = F.posexplode(F.array(*(F.struct(F.lit(t).alias("title"), x.alias("text")) for t, x in texts))).alias("ordinal", "x")
    blocks = p.select("doc_id", each).select("doc_id", "ordinal", F.concat(F.lit("s"), F.col("ordinal").cast("string")).alias("section_id"), "x.title", "x.text")
    fields = p.select("doc_id", F.to_json(F.array(F.struct(F.lit("Keywords").alias("label"), F.array(F.col("p_name"), F.lit("other one")).alias("entries")))).alias("fields"))
    pages = blocks.where("ordinal < 3").select("doc_id", "ordinal", (F.col("ordinal") + 1).alias("page"))
    return keywords.text_units(blocks, fields, pages)


@query("sc23_rewritten_targets", """SELECT page_id AS doc_id, CASE WHEN page_id % 10 <> 0 THEN '<!-- <img src=no> --><p>' || url || '</p><IMG alt="x>y" srcset=''s&amp;t 2x'' src="l/' || page_id || '.png"><object data=b></object>' END AS text,
  CASE WHEN page_id % 10 <> 0 THEN 1 END AS rewrites, CASE WHEN page_id % 10 = 0 THEN 'source_mismatch' END AS error FROM pages""")
def sc23_rewritten_targets(spark, d):
    own = F.col("page_id").cast("string")
    text = F.concat(F.lit("<!-- <img src=no> --><p>"), F.col("url"), F.lit("</p><IMG alt=\"x>y\" srcset='s&amp;t 2x' src=\"a/"), own, F.lit('.png"><object data=b></object>'))
    record = lambda n, element, attribute, target, path: F.struct(F.lit(n).alias("ordinal"), F.lit(element).alias("element"), F.lit(attribute).alias("attribute"), target.alias("target"), path.alias("path"))
    wrong = F.when(F.col("page_id") % 10 == 0, F.lit("other")).otherwise(F.lit("b"))
    records = F.array(
        record(0, "img", "src", F.concat(F.lit("a/"), own, F.lit(".png")), F.concat(F.lit("l/"), own, F.lit(".png"))),
        record(1, "img", "srcset", F.lit("s&t 2x"), F.lit("s&t 2x")), record(2, "object", "data", wrong, F.lit(None).cast("string")),
    )
    return rewrite.materialized(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), text.alias("text"), records.alias("records")))
