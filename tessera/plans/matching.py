"""Matching queries: documents and benchmark items stand for two renditions, pages and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import matching as M
from tessera.operators import ocr as O
from tessera.plans.registry import query, table
from tessera.plans.sections import FP, LINES, lines



def _fp(column: str) -> str:
    return r"array_to_string(regexp_extract_all(lower(" + column + r"), '[\p{L}\p{N}]+'), ' ')"


PAGES = LINES + ", p AS (SELECT doc_id, (line - 1) // 8 + 1 AS page, line, text, " + FP + " AS fp FROM l)"


def pages(spark, d):
    return M.page_lines(lines(spark, d).select("doc_id", F.expr("(line - 1) div 8 + 1").alias("page"), "line", "text"))


def titles(spark, d):
    """The lines that aren't blank, with a number in front, as titles to be found again."""
    rows = lines(spark, d).where("trim(text) <> ''")
    return rows.select("doc_id", F.col("line").alias("key"), F.concat(F.col("line").cast("string"), F.lit(". "), "text").alias("title"))


TITLES = "t AS (SELECT doc_id, line AS key, line || '. ' || text AS title FROM l WHERE trim(text) <> '')"
STRIP = r"regexp_replace(title, '^\s*(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.)\s+', '')"
KEYS = f"k AS (SELECT DISTINCT doc_id, key, unnest([{_fp('title')}, {_fp(STRIP)}]) AS fp FROM t)"


@query("j3_structure", f"""WITH {LINES}, v AS (SELECT doc_id, list(CASE WHEN doc_id % 5 = 0 AND line = 2 THEN 'changed' ELSE {FP} END ORDER BY line) AS v, list({FP} ORDER BY line) AS p FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN p = v THEN 'verified' ELSE 'mismatch' END AS status FROM v""")
def j3_structure(spark, d):
    p = lines(spark, d).select("doc_id", F.col("line").alias("ordinal"), F.col("text").alias("title"))
    v = p.withColumn("title", F.when((F.col("doc_id") % 5 == 0) & (F.col("ordinal") == 2), "changed").otherwise(F.concat(F.lit("* "), "title")))
    return M.structure(p, v)


@query("j4_exact_titles", f"WITH {PAGES}, {TITLES}, {KEYS} SELECT DISTINCT doc_id, key, page FROM k JOIN p USING (doc_id, fp) WHERE fp <> ''")
def j4_exact_titles(spark, d):
    return M.exact_titles(titles(spark, d), pages(spark, d))


JOINED = """j AS (SELECT doc_id, page, fp || ' ' || lead(fp, 1) OVER w AS f2, fp || ' ' || lead(fp, 1) OVER w || ' ' || lead(fp, 2) OVER w AS f3 FROM p WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
u AS (SELECT doc_id, page, f2 AS fp FROM j WHERE f2 IS NOT NULL UNION ALL SELECT doc_id, page, f3 FROM j WHERE f3 IS NOT NULL)"""
TWO = "t AS (SELECT doc_id, line AS key, text || ' ' || n AS title FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line) AS n FROM l) WHERE trim(text) <> '' AND trim(n) <> '')"


def two_line_titles(spark, d):
    from pyspark.sql import Window

    rows = lines(spark, d).withColumn("n", F.lead("text").over(Window.partitionBy("doc_id").orderBy("line")))
    rows = rows.where("trim(text) <> '' and trim(n) <> ''")
    return rows.select("doc_id", F.col("line").alias("key"), F.concat_ws(" ", "text", "n").alias("title"))


@query("j5_joined_titles", f"WITH {PAGES}, {TWO}, {KEYS}, {JOINED} SELECT DISTINCT doc_id, key, page FROM k JOIN u USING (doc_id, fp) WHERE fp <> ''")
def j5_joined_titles(spark, d):
    return M.joined_titles(two_line_titles(spark, d), pages(spark, d))


ANCHOR = f"""
b AS (SELECT item_id AS key, string_split({_fp('text')}, ' ') AS t FROM benchmark), bs AS (SELECT key, i - 1 AS start, array_to_string(t[i : i + 7], ' ') AS sh FROM (SELECT key, t[1 : 128] AS t, unnest(range(1, least(len(t), 128) - 6)) AS i FROM b)),
d AS (SELECT doc_id AS page, string_split({_fp('text')}, ' ') AS t FROM documents WHERE text IS NOT NULL), ds AS (SELECT DISTINCT page, array_to_string(t[i : i + 7], ' ') AS sh FROM (SELECT page, t, unnest(range(1, len(t) - 6)) AS i FROM d)),
h AS (SELECT key, start, min(page) AS page FROM bs JOIN ds USING (sh) GROUP BY key, start HAVING count(DISTINCT page) = 1)"""


@query("j6_body_anchor", f"WITH {ANCHOR} SELECT key, min(start) AS start, arg_min(page, start) AS page FROM h GROUP BY key")
def j6_body_anchor(spark, d):
    bodies = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text")
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("page"), "text")
    return M.body_anchors(bodies, docs)


@query("j7_best_evidence", f"""WITH {PAGES}, {TITLES}, {KEYS}, {JOINED},
e AS (SELECT DISTINCT doc_id || '-' || key AS key, page, 'exact' AS tier FROM k JOIN p USING (doc_id, fp) WHERE fp <> '' UNION ALL SELECT DISTINCT doc_id || '-' || key, page, 'joined' FROM k JOIN u USING (doc_id, fp) WHERE fp <> ''),
r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY key, tier) = 1 THEN CASE tier WHEN 'exact' THEN 1 ELSE 2 END ELSE CASE tier WHEN 'exact' THEN 4 ELSE 5 END END AS rank FROM e)
SELECT key, page, tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, page) AS r FROM r) WHERE r = 1""")
def j7_best_evidence(spark, d):
    t, p = titles(spark, d), pages(spark, d)
    key = F.concat_ws("-", "doc_id", "key").alias("key")
    exact = M.exact_titles(t, p).select(key, "page", F.lit("exact").alias("tier"))
    return M.best_evidence(exact.unionByName(M.joined_titles(t, p).select(key, "page", F.lit("joined").alias("tier"))))


@query("j8_formula_pages", f"""WITH {LINES}, m AS (SELECT doc_id, line AS key, regexp_replace(text, '[^\\p{{L}}\\p{{N}}_=+*/^-]', '', 'g') AS f FROM l),
g AS (SELECT doc_id, (line - 1) // 8 + 1 AS page, string_agg(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_=+*/^-]', '', 'g'), '' ORDER BY line) AS pf FROM l GROUP BY ALL)
SELECT m.doc_id, key, page FROM m JOIN g ON m.doc_id = g.doc_id AND contains(pf, f) WHERE length(f) >= 3""")
def j8_formula_pages(spark, d):
    from tessera.functions import text as T

    rows = lines(spark, d).select("doc_id", "line", T.math_fingerprint(F.col("text")).alias("f"))
    spans = rows.select("doc_id", F.col("line").alias("key"), "f").where("length(f) >= 3")
    g = rows.groupBy("doc_id", F.expr("(line - 1) div 8 + 1").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "f"))), lambda x: x["f"]), "").alias("pf"))
    return spans.join(g, "doc_id").where(F.contains("pf", F.col("f"))).select("doc_id", "key", "page")


PH = f"""
b AS (SELECT item_id AS key, {_fp('text')} AS fp FROM benchmark), d AS (SELECT doc_id AS page, {_fp('text')} AS pf FROM documents WHERE text IS NOT NULL),
h AS (SELECT key, page FROM b JOIN d ON contains(' ' || pf || ' ', ' ' || fp || ' ') WHERE len(string_split(fp, ' ')) >= 2 AND length(replace(fp, ' ', '')) >= 8)"""


@query("j9_phrase_pages", f"WITH {PH} SELECT key, min(page) AS page FROM h GROUP BY key HAVING count(*) = 1")
def j9_phrase_pages(spark, d):
    blocks = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text")
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("page"), "text")
    return M.phrase_pages(blocks, docs)


@query("j14_running_headers", """WITH i AS (SELECT l_suppkey AS doc_id, l_returnflag || l_linestatus AS key, l_orderkey AS page, l_quantity * 20 AS y FROM lineitem),
n AS (SELECT *, CASE WHEN y - coalesce(lag(y) OVER (PARTITION BY doc_id, key ORDER BY y, page), -1e9) > 10 THEN 1 ELSE 0 END AS new FROM i),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, key ORDER BY y, page ROWS UNBOUNDED PRECEDING) AS run FROM n),
p AS (SELECT doc_id, key, run, count(DISTINCT page) AS pages FROM r GROUP BY ALL HAVING count(DISTINCT page) >= 2)
SELECT doc_id, key, max(pages) AS pages FROM p GROUP BY doc_id, key""")
def j14_running_headers(spark, d):
    i = table(spark, d, "lineitem")
    return M.running_headers(i.select(F.col("l_suppkey").alias("doc_id"), F.concat("l_returnflag", "l_linestatus").alias("key"), F.col("l_orderkey").alias("page"), (F.col("l_quantity") * 20).alias("y")))


@query("g1_running_headers", """WITH i AS (SELECT source AS doc_id, lang AS key, doc_id AS page, n_chars % 900 AS y FROM documents),
n AS (SELECT *, CASE WHEN y - coalesce(lag(y) OVER (PARTITION BY doc_id, key ORDER BY y, page), -1e9) > 10 THEN 1 ELSE 0 END AS new FROM i),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, key ORDER BY y, page ROWS UNBOUNDED PRECEDING) AS run FROM n),
p AS (SELECT doc_id, key, run, count(DISTINCT page) AS pages FROM r GROUP BY ALL HAVING count(DISTINCT page) >= 2)
SELECT doc_id, key, max(pages) AS pages FROM p GROUP BY doc_id, key""")
def g1_running_headers(spark, d):
    i = table(spark, d, "documents")
    return M.running_headers(i.select(F.col("source").alias("doc_id"), F.col("lang").alias("key"), F.col("doc_id").alias("page"), (F.col("n_chars") % 900).cast("double").alias("y")))


@query("g4_page_coverage", """WITH e AS (SELECT l_partkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN 'excluded' WHEN l_quantity >= 50 THEN 'unavailable' ELSE 'included' END AS s FROM lineitem),
f AS (SELECT doc_id, count(*) FILTER (s <> 'excluded') AS n, bool_or(s = 'included') AS seen, bool_or(s = 'unavailable') AS lost FROM e GROUP BY doc_id),
p AS (SELECT p_partkey AS doc_id, CASE WHEN p_size % 10 <> 0 THEN p_size END AS size, p_size % 40 AS expected, coalesce(n, 0) AS n, coalesce(seen, false) AS seen, coalesce(lost, false) AS lost FROM part LEFT JOIN f ON doc_id = p_partkey)
SELECT doc_id, 1 AS page, CASE WHEN size IS NULL OR n < expected OR lost THEN CASE WHEN seen THEN 'partial' ELSE 'unavailable' END WHEN seen THEN 'parsed' ELSE 'empty' END AS status FROM p""")
def g4_page_coverage(spark, d):
    size = F.col("p_size")
    pages_ = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.when(size % 10 != 0, size).alias("size"), (size % 40).alias("expected"), F.lit("").alias("status"))
    status = F.when(F.col("l_returnflag") == "R", "excluded").when(F.col("l_quantity") >= 50, "unavailable").otherwise("included")
    ids = F.when(status == "included", F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))
    entries = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.lit(1).alias("page"), status.alias("status"), ids.alias("source_ids"))
    return O.page_status(pages_, entries).drop("stated")


@query("g5_box_errors", """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, [l_quantity, l_discount * 1000, l_extendedprice / 50, l_tax * 10000] AS box FROM lineitem),
e AS (SELECT id, CASE WHEN len(list_filter(box, lambda v: v < 0 OR v > 1000)) > 0 THEN 'out_of_range' WHEN box[1] > box[3] OR box[2] > box[4] THEN 'order' END AS error FROM b) SELECT * FROM e WHERE error IS NOT NULL""")
def g5_box_errors(spark, d):
    r = table(spark, d, "lineitem")
    box = F.array(F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_extendedprice") / 50, F.col("l_tax") * 10000)
    return M.box_errors(r.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), box.alias("box")))


@query("j18_verdicts", """WITH r AS (SELECT doc_id AS key, CASE WHEN quality = 1 THEN 'exact' ELSE 'mismatch' END AS verdict FROM labels UNION ALL SELECT doc_id, 'exact' FROM labels WHERE toxic = 1),
n AS (SELECT doc_id AS key, count(verdict) AS n, min(verdict) AS v FROM documents LEFT JOIN r ON doc_id = key GROUP BY doc_id)
SELECT key, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN v = 'exact' THEN 'verified' ELSE 'mismatch' END AS status FROM n""")
def j18_verdicts(spark, d):
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "key")
    reviews = labels.select("key", F.when(F.col("quality") == 1, "exact").otherwise("mismatch").alias("verdict")).unionByName(labels.where("toxic = 1").select("key", F.lit("exact").alias("verdict")))
    return M.verdicts(table(spark, d, "documents").select(F.col("doc_id").alias("key")), reviews)


@query("j19_bijection", """SELECT label, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right FROM (SELECT c_nationkey AS label, count(*) AS n FROM customer GROUP BY 1) l
FULL JOIN (SELECT s_nationkey AS label, count(*) AS n FROM supplier GROUP BY 1) r USING (label) WHERE coalesce(l.n, 0) <> 1 OR coalesce(r.n, 0) <> 1""")
def j19_bijection(spark, d):
    return M.bijection(table(spark, d, "customer").select(F.col("c_nationkey").alias("label")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("label")))


@query("j20_unique_ranges", """WITH s AS (SELECT p_partkey AS section, p_size AS a, p_size + p_partkey % 97 AS b FROM part), o AS (SELECT a, b, min(section) AS section FROM s GROUP BY a, b HAVING count(*) = 1)
SELECT l_orderkey * 10 + l_linenumber AS target, section FROM lineitem JOIN o ON a = l_quantity::INT AND b = l_quantity::INT + l_suppkey % 97""")
def j20_unique_ranges(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("section"), F.col("p_size").cast("int").alias("start"), (F.col("p_size") + F.col("p_partkey") % 97).cast("int").alias("end"))
    q = F.col("l_quantity").cast("int")
    t = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("target"), q.alias("start"), (q + F.col("l_suppkey") % 97).cast("int").alias("end"))
    return M.unique_ranges(t, s)


@query("j22_accounting", """WITH e AS (SELECT doc_id AS id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT -item_id - 1 FROM benchmark WHERE item_id < 3), n AS (SELECT id, count(*) AS n FROM e GROUP BY id)
SELECT coalesce(d.doc_id, n.id) AS id, coalesce(n, 0) AS n, d.doc_id IS NULL AS "foreign" FROM documents d FULL JOIN n ON d.doc_id = n.id WHERE d.doc_id IS NULL OR n IS NULL OR n <> 1""")
def j22_accounting(spark, d):
    labels = table(spark, d, "labels")
    e = labels.select(F.col("doc_id").alias("id")).unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("id")))
    e = e.unionByName(table(spark, d, "benchmark").where("item_id < 3").select((-F.col("item_id") - 1).alias("id")))
    return M.accounted(table(spark, d, "documents").select(F.col("doc_id").alias("id")), e)


@query("j23_label_projection", """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS block, l_partkey AS label FROM lineitem), o AS (SELECT *, count(*) OVER (PARTITION BY doc_id, label) AS k FROM b),
v AS (SELECT o.doc_id, block, label, (block * 7 + doc_id) % 5 > 0 AS ok FROM o WHERE k = 1), w AS (SELECT *, bool_and(ok) OVER (PARTITION BY doc_id) AS whole FROM v) SELECT doc_id, block, label FROM w WHERE whole""")
def j23_label_projection(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block"), F.col("l_partkey").alias("label"))
    return M.label_projection(b, b.where("(block * 7 + doc_id) % 5 > 0").select("doc_id", "label").distinct())


@query("j24_note_anchors", """WITH a AS (SELECT doc_id, text, strpos(text, 'the') - 1 AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, s, s >= 0 AND text[s + 1 : s + 3] = 'the' AS anchored FROM a""")
def j24_note_anchors(spark, d):
    s = F.instr("text", "the") - 1
    return table(spark, d, "documents").where("text is not null").select("doc_id", s.alias("s"), ((s >= 0) & (F.substring("text", s + 1, F.lit(3)) == "the")).alias("anchored"))


@query("j25_grid_overlaps", """WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS r0, (l_quantity % 4)::INT AS c0, 1 + (l_partkey % 2)::INT AS h, 1 + (l_suppkey % 2)::INT AS w FROM lineitem),
p AS (SELECT doc_id, r, unnest(range(c0, c0 + w)) AS c FROM (SELECT doc_id, unnest(range(r0, r0 + h)) AS r, c0, w FROM c)) SELECT doc_id, r, c, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1""")
def j25_grid_overlaps(spark, d):
    r = table(spark, d, "lineitem")
    one = lambda c: (1 + F.col(c) % 2).cast("int")
    return M.grid_overlaps(r.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row"), (F.col("l_quantity") % 4).cast("int").alias("col"), one("l_partkey").alias("rows"), one("l_suppkey").alias("cols")))


@query("j26_shared_words", f"""WITH a AS (SELECT item_id AS key, {_fp('b.text')} AS x, {_fp('d.text')} AS y FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT key, len(list_intersect(list_filter(string_split(x, ' '), lambda w: length(w) >= 4 AND w NOT IN ('that', 'with', 'from', 'this')), string_split(y, ' '))) AS shared FROM a""")
def j26_shared_words(spark, d):
    left = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text")
    right = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("key"), "text")
    return M.shared_words(left, right, ["that", "with", "from", "this"])


@query("j13_masked_ranges", f"""WITH {LINES}, c AS (SELECT doc_id, 3 AS a, 5 AS b FROM l WHERE line = 1 AND doc_id % 2 = 0)
SELECT l.doc_id, line FROM l WHERE contains(text, 'the') AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND line BETWEEN a AND b)""")
def j13_masked_ranges(spark, d):
    rows = lines(spark, d)
    child = rows.where("line = 1 and doc_id % 2 = 0").select("doc_id", F.lit(3).alias("a"), F.lit(5).alias("b"))
    hits = rows.where(F.contains("text", F.lit("the"))).select("doc_id", "line")
    c = child.withColumnRenamed("doc_id", "c_doc")
    return hits.join(c, (F.col("doc_id") == F.col("c_doc")) & F.col("line").between(F.col("a"), F.col("b")), "left_anti")


@query("a16_label_anomalies", """WITH e AS (SELECT user_id AS doc_id, event_id AS ordinal, event_id % 11 AS label FROM events),
r AS (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY ordinal) AS p, row_number() OVER (PARTITION BY doc_id, label ORDER BY ordinal) > 1 AS again FROM e)
SELECT doc_id, bool_or(again) AS duplicates, bool_or(coalesce(label < p, false)) AS regressions, bool_or(coalesce(label > p + 1, false)) AS gaps FROM r GROUP BY doc_id HAVING count(*) >= 2""")
def a16_label_anomalies(spark, d):
    return M.label_anomalies(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 11).alias("label")))
