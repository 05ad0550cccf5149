"""Queries on sections and lines. A document's lines serve as its entries; their length gives a level from 1 to 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ocr as O
from tessera.operators import sections as S
from tessera.plans.registry import query, table

LINES = "l AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS line, unnest(w) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL))"
ENTRIES = LINES + ", e AS (SELECT doc_id, line AS ordinal, (1 + length(text) % 4)::INT AS level, max(line) OVER (PARTITION BY doc_id) AS last FROM l)"


def lines(spark, d):
    return S.lines(table(spark, d, "documents"))


def entries(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    w = F.split("text", "\n", -1)
    rows = docs.select("doc_id", F.size(w).alias("last"), F.posexplode(w).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).alias("ordinal"), (1 + F.length("text") % 4).alias("level"), "last")


def sections(spark, d):
    rows = lines(spark, d).where("trim(text) <> ''")
    return rows.select("doc_id", F.col("line").alias("ordinal"), F.concat(F.lit("sec-"), F.col("line").cast("string")).alias("section_id"), F.col("text").alias("title"), "text")


SEC = LINES + ", s AS (SELECT doc_id, line AS ordinal, 'sec-' || line AS section_id, text AS title, text FROM l WHERE trim(text) <> '')"


@query("pf1_toc", f"WITH {SEC} SELECT doc_id, ordinal, section_id, title FROM s")
def pf1_toc(spark, d):
    return S.toc(sections(spark, d))


@query("pf2_select_ordinal", f"WITH {SEC} SELECT doc_id, max(section_id) FILTER (ordinal = 2) AS section_id, CASE WHEN count(*) FILTER (ordinal = 2) = 0 THEN 'section_not_found' END AS error FROM s GROUP BY doc_id")
def pf2_select_ordinal(spark, d):
    return S.select_section(sections(spark, d), 2)


SELECT = SEC + r""", t AS (SELECT *, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS n FROM s),
r AS (SELECT *, CASE WHEN n = '{x}' OR section_id = '{x}' THEN 1 WHEN contains(n, '{x}') THEN 2 END AS tier FROM t),
b AS (SELECT *, min(tier) OVER (PARTITION BY doc_id) AS best FROM r),
g AS (SELECT doc_id, count(*) FILTER (tier = best) AS n, min(section_id) FILTER (tier = best) AS section_id FROM b GROUP BY doc_id)
SELECT doc_id, CASE WHEN n = 1 THEN section_id END AS section_id, CASE WHEN n = 0 THEN 'section_not_found' WHEN n > 1 THEN 'section_ambiguous' END AS error FROM g"""


@query("pf2_select_title", "WITH " + SELECT.replace("{x}", "licensed under"))
def pf2_select_title(spark, d):
    return S.select_section(sections(spark, d), "Licensed  under")


@query("pf3_select_entry", "WITH " + SELECT.replace("{x}", "sec-3"))
def pf3_select_entry(spark, d):
    return S.select_section(sections(spark, d), "sec-3")


@query("pf4_source_range", f"WITH {LINES} SELECT doc_id, line, text FROM l WHERE line BETWEEN 2 AND 4")
def pf4_source_range(spark, d):
    return S.source_range(table(spark, d, "documents"), 2, 4)


@query(
    "w1_section_parents",
    f"WITH {ENTRIES} SELECT doc_id, ordinal, level, (SELECT max(p.ordinal) FROM e p WHERE p.doc_id = e.doc_id AND p.ordinal < e.ordinal AND p.level < e.level) AS parent FROM e",
)
def w1_section_parents(spark, d):
    return S.parents(entries(spark, d)).drop("last")


@query(
    "w3_section_ends",
    f"WITH {ENTRIES} SELECT doc_id, ordinal, level, coalesce((SELECT min(p.ordinal) FROM e p WHERE p.doc_id = e.doc_id AND p.ordinal > e.ordinal AND p.level <= e.level) - 1, last) AS \"end\" FROM e",
)
def w3_section_ends(spark, d):
    return S.ends(entries(spark, d), "last").drop("last")


@query(
    "w5_section_paths",
    f"""WITH {ENTRIES} SELECT a.doc_id, a.ordinal, string_agg(b.ordinal, ',' ORDER BY b.ordinal) AS path FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.ordinal <= a.ordinal
AND (b.ordinal = a.ordinal OR b.level < a.level) AND NOT EXISTS (SELECT 1 FROM e c WHERE c.doc_id = a.doc_id AND c.ordinal > b.ordinal AND c.ordinal <= a.ordinal AND c.level <= b.level) GROUP BY a.doc_id, a.ordinal""",
)
def w5_section_paths(spark, d):
    return S.paths(entries(spark, d)).select("doc_id", "ordinal", F.array_join("path", ",").alias("path"))


@query(
    "w2_section_slices",
    f"WITH {ENTRIES}, h AS (SELECT doc_id, ordinal AS line, last FROM e WHERE level = 1) SELECT doc_id, line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, last) AS stop FROM h",
)
def w2_section_slices(spark, d):
    return S.slices(entries(spark, d).where("level = 1").select("doc_id", F.col("ordinal").alias("line"), "last"), "last").drop("last")


@query(
    "w4_unmatched_parents",
    f"""WITH {ENTRIES}, m AS (SELECT doc_id, ordinal, CASE WHEN level = 2 THEN ordinal END AS k FROM e)
SELECT doc_id, ordinal, last_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM m""",
)
def w4_unmatched_parents(spark, d):
    rows = entries(spark, d).withColumn("k", F.when(F.col("level") == 2, F.col("ordinal")))
    return S.marked(rows, "doc_id", ["ordinal"], "k", "parent").select("doc_id", "ordinal", "parent")


@query(
    "w9_neighbour_lines",
    f"""WITH {LINES}, t AS (SELECT *, CASE WHEN trim(text) <> '' THEN trim(text) END AS f FROM l)
SELECT doc_id, line, md5(coalesce(last_value(f IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS before,
  md5(coalesce(first_value(f IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')) AS after FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line)""",
)
def w9_neighbour_lines(spark, d):
    rows = S.neighbours(lines(spark, d))
    return rows.select("doc_id", "line", *(F.md5(F.coalesce(c, F.lit("")).cast("binary")).alias(c) for c in ("before", "after")))


@query(
    "w11_context_lines",
    f"WITH {LINES}, c AS (SELECT doc_id, line, text, string_agg(text, chr(10)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM l) SELECT doc_id, line, md5(a) AS around FROM c WHERE contains(text, 'License')",
)
def w11_context_lines(spark, d):
    rows = S.context(lines(spark, d), 1).where(F.contains("text", F.lit("License")))
    return rows.select("doc_id", "line", F.md5(F.col("around").cast("binary")).alias("around"))


EV = "e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(
    "j10_asof_backward",
    """WITH m AS (SELECT *, CASE WHEN event_type = 'signup' THEN event_id END AS k FROM events)
SELECT event_id, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marker FROM m""",
)
def j10_asof_backward(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return S.marked(rows, "user_id", ["ts", "event_id"], "k", "marker").select("event_id", "marker")


@query(
    "j11_asof_forward",
    """WITH m AS (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS k FROM events)
SELECT event_id, first_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM m""",
)
def j11_asof_forward(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return S.following(rows, "user_id", ["ts", "event_id"], "k", "next").select("event_id", "next")


@query(
    "w7_running_page",
    f"""WITH {LINES}, p AS (SELECT doc_id, line, CASE WHEN line % 5 = 1 THEN line // 5 + 1 END AS m FROM l)
SELECT doc_id, line, last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS page FROM p""",
)
def w7_running_page(spark, d):
    rows = lines(spark, d).withColumn("m", F.when(F.col("line") % 5 == 1, F.expr("line div 5 + 1")))
    return S.marked(rows, "doc_id", ["line"], "m", "page").select("doc_id", "line", "page")


RANGES = """r AS (SELECT o_custkey AS k, o_orderkey AS id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS a FROM orders),
q AS (SELECT o_custkey AS k, o_orderkey AS id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS c FROM orders)"""


@query("j12_interval_overlap", f"WITH {RANGES} SELECT r.k, r.id AS lid, q.id AS rid FROM r JOIN q ON r.k = q.k AND r.id < q.id AND a + 45 >= c AND a <= c + 60")
def j12_interval_overlap(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("t"))
    left = o.select("k", F.col("o_orderkey").alias("lid"), F.col("t").alias("a"), (F.col("t") + 45).alias("b"))
    right = o.select("k", F.col("o_orderkey").alias("rid"), F.col("t").alias("c"), (F.col("t") + 60).alias("d"))
    return S.overlapping(left, right, "k", 60).where("lid < rid").select("k", "lid", "rid")


@query(
    "w8_not_increasing",
    "SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE value <= p",
)
def w8_not_increasing(spark, d):
    return S.strictly_increasing(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id")


@query(
    "a8_expected_entries",
    f"""WITH {LINES}, k AS (SELECT doc_id, line, CASE WHEN length(text) % 2 = 0 THEN 'ref' ELSE 'text' END AS kind FROM l),
p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM k) SELECT doc_id, count(*) FILTER (NOT (kind = 'ref' AND coalesce(b, '') = 'ref')) AS expected FROM p GROUP BY doc_id""",
)
def a8_expected_entries(spark, d):
    rows = lines(spark, d).withColumn("kind", F.when(F.length("text") % 2 == 0, "ref").otherwise("text"))
    return S.islands(rows, "doc_id", "line", "kind", "ref")


@query("mp6_page_sections", f"""WITH {LINES}, p AS (SELECT doc_id, (line - 1) // 10 AS page, line, text FROM l),
g AS (SELECT doc_id, page, list(trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY line) FILTER (trim(text) <> '') AS x, count(*) AS n_lines FROM p GROUP BY doc_id, page)
SELECT doc_id, page + 1 AS page, coalesce(x[1], 'Page ' || (page + 1)) AS title, n_lines FROM g""")
def mp6_page_sections(spark, d):
    rows = lines(spark, d).withColumn("page", F.expr("(line - 1) div 10 + 1"))
    first = F.min_by(T.collapse(F.col("text")), F.when(F.trim("text") != "", F.col("line")))
    g = rows.groupBy("doc_id", "page").agg(first.alias("t"), F.count(F.lit(1)).alias("n_lines"))
    return g.select("doc_id", "page", F.coalesce("t", F.concat(F.lit("Page "), F.col("page").cast("string"))).alias("title"), "n_lines")


# -- scalar functions and predicates over lines and documents


@query("pf8_term_titles", """WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Key words' WHEN 1 THEN 'KEYWORD' WHEN 2 THEN 'Subject Index 2' WHEN 3 THEN 'Key-terms:' WHEN 4 THEN 'Glossary'
  WHEN 5 THEN 'Index Terms' WHEN 6 THEN p_name ELSE 'Index' END AS title FROM part) SELECT p_partkey, p_partkey % 8 IN (0, 1, 2, 3, 5, 7) AS term_title FROM t""")
def pf8_term_titles(spark, d):
    titles = F.array(*(F.lit(t) for t in ("Key words", "KEYWORD", "Subject Index 2", "Key-terms:", "Glossary", "Index Terms", "", "Index")))
    k = F.col("p_partkey") % 8
    title = F.when(k == 6, F.col("p_name")).otherwise(F.element_at(titles, (k + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", T.is_term_title(title).alias("term_title"))


@query("pf9_equation_lines", rf"""WITH {LINES} SELECT doc_id, line, regexp_matches(text, '[=<>+*/^≤≥≈∑∫-]') AND (regexp_matches(text, '\(\d+(?:\.\d+)*\)\s*$') OR len(string_split_regex(trim(text), '\s+')) <= 24) AS equation FROM l""")
def pf9_equation_lines(spark, d):
    return lines(spark, d).select("doc_id", "line", T.looks_like_equation(F.col("text")).alias("equation"))


@query("pf10_substantive", r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 10 AND trim(text) NOT IN ('{}', '[]') AS substantive FROM documents WHERE text IS NOT NULL")
def pf10_substantive(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.is_substantive(F.col("text")).alias("substantive"))


FP = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ')"


@query("pf12_page_evidence", f"WITH {LINES}, f AS (SELECT doc_id, line, {FP} AS fp FROM l) SELECT doc_id, line, len(string_split(fp, ' ')) >= 2 AND length(replace(fp, ' ', '')) >= 8 AS evidence FROM f")
def pf12_page_evidence(spark, d):
    return lines(spark, d).select("doc_id", "line", T.has_page_evidence(T.fingerprint(F.col("text"))).alias("evidence"))


@query("pf13_page_coverage", """WITH f AS (SELECT doc_id AS page, count(*) AS found FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL) WHERE length(t) > 200 GROUP BY doc_id)
SELECT doc_id AS page, CASE WHEN text IS NOT NULL AND found >= 3 THEN 'parsed' WHEN found > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM documents LEFT JOIN f ON page = doc_id""")
def pf13_page_coverage(spark, d):
    page = [F.lit(0).alias("doc_id"), F.col("doc_id").alias("page")]
    pages = table(spark, d, "documents").select(*page, F.length("text").alias("size"), F.lit(3).alias("expected"), F.lit("").alias("status"))
    entries = lines(spark, d).where(F.length("text") > 200).select(*page, F.lit("included").alias("status"), F.array(F.lit("n")).alias("source_ids"))
    return O.page_status(pages, entries).select("page", "status")


@query("st1_normalized", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL")
def st1_normalized(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.normalized(F.col("text")).cast("binary")).alias("h"))


@query("st3_fingerprint", f"SELECT doc_id, md5({FP}) AS h FROM documents WHERE text IS NOT NULL")
def st3_fingerprint(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.fingerprint(F.col("text")).cast("binary")).alias("h"))


@query("st4_math_fingerprint", r"SELECT doc_id, md5(regexp_replace(text, '[^\p{L}\p{N}_=+*/^-]', '', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def st4_math_fingerprint(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.math_fingerprint(F.col("text")).cast("binary")).alias("h"))


@query("st5_term_pattern", r"""WITH w AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda w: w IN ('the', 'license'))) AS n FROM w""")
def st5_term_pattern(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.term_count(F.col("text"), ["the", "license"]).alias("n"))


@query("st7_clip", """WITH p AS (SELECT doc_id, text, strpos(text, 'on ') - 1 AS s, strpos(text, 'on ') + 1 AS e, length(text) AS n FROM documents WHERE strpos(text, 'on ') > 0),
a AS (SELECT *, greatest(0, least(s - (400 - (e - s)) // 2, n - 400)) AS a FROM p), b AS (SELECT *, least(n, a + 400) AS b FROM a)
SELECT doc_id, md5(CASE WHEN n <= 400 THEN text ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || trim(text[a + 1 : b]) || CASE WHEN b < n THEN '…' ELSE '' END END) AS h FROM b""")
def st7_clip(spark, d):
    s = F.instr("text", "on ") - 1
    return table(spark, d, "documents").where(s >= 0).select("doc_id", F.md5(T.clip(F.col("text"), s, s + 2).cast("binary")).alias("h"))


@query("st10_section_number", r"SELECT p_partkey, regexp_replace(s, '^\s*(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.)\s+', '') AS title FROM (SELECT p_partkey, p_size || '.' || (p_partkey % 7) || ' ' || p_name AS s FROM part)")
def st10_section_number(spark, d):
    p = table(spark, d, "part")
    s = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(" "), F.col("p_name"))
    return p.select("p_partkey", T.strip_section_number(s).alias("title"))


@query("st11_outline_title", r"""SELECT p_partkey, array_to_string(regexp_extract_all(lower(regexp_replace(p_name, '[\s.]*\d+\s*$', '')), '[\p{L}\p{N}]+'), ' ') AS title FROM part""")
def st11_outline_title(spark, d):
    return table(spark, d, "part").select("p_partkey", T.outline_title(F.concat(F.lit("Chapter "), F.col("p_size").cast("string"), F.lit(". "), F.col("p_name"))).alias("title"))


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1))"
ERR = r"""CASE WHEN NOT regexp_matches(url, '^(?i:https)://') THEN 'scheme_not_https' WHEN regexp_matches(url, '^[^/]*//[^/?#]*@') THEN 'credentials'
WHEN regexp_matches(url, '^[^/]*//[^/?#]*:\d+') THEN 'port' WHEN contains(url, '#') THEN 'fragment' WHEN """ + HOST + " = '' THEN 'host_missing' END"


@query("st12_https_url", rf"""WITH e AS (SELECT page_id, url, {ERR} AS error FROM pages), r AS (SELECT *, regexp_extract(url, '^[A-Za-z]+://[^/?#]+(.*)$', 1) AS rest FROM e)
SELECT page_id, error, CASE WHEN error IS NULL THEN 'https://' || {HOST} || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS url FROM r""")
def st12_https_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_error(F.col("url")).alias("error"), T.https_url(F.col("url")).alias("url"))


@query("st13_media_type", r"""WITH s AS (SELECT page_id, lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS x FROM pages)
SELECT page_id, CASE x WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' ELSE 'application/octet-stream' END AS media_type FROM s""")
def st13_media_type(spark, d):
    return table(spark, d, "pages").select("page_id", T.media_type(F.col("url")).alias("media_type"))


@query("sc1_source_format", r"""WITH s AS (SELECT page_id, lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS x FROM pages)
SELECT page_id, CASE WHEN x IN ('html', 'htm') THEN 'html' WHEN x IN ('md', 'markdown') THEN 'markdown' WHEN x IN ('tex', 'pdf') THEN x ELSE 'unsupported_source' END AS format FROM s""")
def sc1_source_format(spark, d):
    return table(spark, d, "pages").select("page_id", T.source_format(F.col("url")).alias("format"))


def _redact_sql(column: str) -> str:
    for pattern, put in T.redaction_steps("\\"):
        p = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '{p}', '{put}', 'g')"
    return column


@query("st14_redact", f"SELECT doc_id, md5({_redact_sql('text')}) AS h, contains({_redact_sql('text')}, '[REDACTED]') AS redacted FROM documents WHERE text IS NOT NULL")
def st14_redact(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", T.redact(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("h"), F.contains("t", F.lit("[REDACTED]")).alias("redacted"))


@query("st15_failure_class", """WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'HTTP 401: Unauthorized' WHEN 1 THEN 'quota exceeded' WHEN 2 THEN '429 slow down, Retry-After: ' || event_id WHEN 3 THEN 'invalid_request' WHEN 4 THEN 'rate-limited; retry after 0.5' WHEN 5 THEN 'input_too_large' ELSE 'reset' END AS x FROM events)
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'authentication' WHEN 1 THEN 'quota' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'invalid_request' WHEN 4 THEN 'rate_limit' WHEN 5 THEN 'invalid_request' ELSE 'transport' END AS category,
  event_id % 7 IN (2, 4, 6) AS retryable, CASE event_id % 7 WHEN 2 THEN least(greatest(event_id::DOUBLE, 1), 3600) WHEN 4 THEN 1.0 END AS retry_after FROM e""")
def st15_failure_class(spark, d):
    k = F.col("event_id") % 7
    x = F.when(k == 0, "HTTP 401: Unauthorized").when(k == 1, "quota exceeded").when(k == 2, F.concat(F.lit("429 slow down, Retry-After: "), F.col("event_id").cast("string")))
    x = x.when(k == 3, "invalid_request").when(k == 4, "rate-limited; retry after 0.5").when(k == 5, "input_too_large").otherwise("reset")
    rows = table(spark, d, "events").select("event_id", x.alias("x")).withColumn("category", T.failure_category(F.col("x")))
    return rows.select("event_id", "category", T.retryable(F.col("category")).alias("retryable"), T.retry_after(F.col("x")).alias("retry_after"))


@query("st16_identifiers", "SELECT s_suppkey, regexp_matches(s_name, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\\z') AS identifier, regexp_matches(md5(s_name) || md5(s_name), '^[0-9a-f]{64}\\z') AS digest FROM supplier")
def st16_identifiers(spark, d):
    h = F.concat(F.md5(F.col("s_name").cast("binary")), F.md5(F.col("s_name").cast("binary")))
    return table(spark, d, "supplier").select("s_suppkey", T.is_identifier(F.col("s_name")).alias("identifier"), T.is_digest(h).alias("digest"))


@query("st17_semantic_ids", "SELECT doc_id, 'sec-' || sha256(lang || chr(0) || source)[1 : 20] AS id FROM documents")
def st17_semantic_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.semantic_id("sec", F.col("lang"), F.col("source")).alias("id"))


@query("st18_preview", rf"""WITH r AS (SELECT doc_id, trim(regexp_replace({_redact_sql('text')}, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE t[1 : 199] || '…' END AS preview FROM r""")
def st18_preview(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("st21_prompts", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def st21_prompts(spark, d):
    part = F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("t"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return g.select("conv_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("prompt"))


@query("st9_markdown_plain", "SELECT p_partkey, p_name || ' and ' || p_type AS t FROM part")
def st9_markdown_plain(spark, d):
    s = F.concat(F.lit("**"), F.col("p_name"), F.lit("** and  ["), F.col("p_type"), F.lit("](https://x/y)"))
    return table(spark, d, "part").select("p_partkey", T.markdown_plain(s).alias("t"))


@query("st9_tex_plain", "SELECT p_partkey, p_name || ' x ' || p_type AS t FROM part")
def st9_tex_plain(spark, d):
    s = F.concat(F.lit("\\emph{"), F.col("p_name"), F.lit("} \\label{a} $x$ "), F.col("p_type"), F.lit(" % note"))
    return table(spark, d, "part").select("p_partkey", T.tex_plain(s).alias("t"))


@query("sx1_ceil", "SELECT o_orderkey, (3 * o_custkey + 1) // 2 AS k FROM orders")
def sx1_ceil(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr("(3 * o_custkey + 1) div 2").alias("k"))


@query("sx2_clamp", "SELECT c_custkey, least(greatest(c_acctbal, 1.0), 3600.0) AS v FROM customer")
def sx2_clamp(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.clamp(F.col("c_acctbal"), 1.0, 3600.0).alias("v"))


@query("sx4_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def sx4_timestamps(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


@query("sx5_sorted_sets", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id")
def sx5_sorted_sets(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("sx6_map_merge", "SELECT event_id, event_type AS a, user_id::VARCHAR AS b FROM events")
def sx6_map_merge(spark, d):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("user_id").cast("string"))
    new = F.create_map(F.lit("a"), F.col("event_type"))
    merged = F.map_from_entries(F.concat(F.map_entries(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))), F.map_entries(new)))
    return table(spark, d, "events").select("event_id", merged["a"].alias("a"), merged["b"].alias("b"))
