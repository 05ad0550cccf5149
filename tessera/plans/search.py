"""Search queries over ``documents``; a document is one section with its first line as title."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import search as S
from tessera.plans.registry import query, table

TERMS = ("the", "and", "una", "der")
_WS = r"'\s+', ' ', 'g'"
LINES = r"""
sec AS (SELECT doc_id, lang, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, lang, text, lines, coalesce(lines[1], '') AS title FROM sec)
"""


def sections(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.lit(0).alias("ordinal"), F.coalesce(T.first_line(F.col("text")), F.lit("")).alias("title"), "text")


def units(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("unit"), "text")


def _lit(s: str) -> str:
    return s.replace("'", "''")


FULL = f"""
WITH {LINES},
m AS (SELECT *, contains(lower(title), '{{n}}') AS t, contains(lower(array_to_string(lines, ' ')), '{{n}}') AS x,
  list_position(list_transform(lines, lambda l: contains(lower(l), '{{n}}')), true) AS pos FROM s),
h AS (SELECT *, array_to_string(lines, ' ') AS whole, strpos(lower(array_to_string(lines, ' ')), '{{n}}') - 1 AS place FROM m WHERE t OR x),
r AS (SELECT doc_id, title, CASE WHEN t THEN 'title' ELSE 'text' END AS matched_in,
  CASE WHEN t THEN concat_ws(chr(10), title, lines[1])
    WHEN pos > 0 THEN array_to_string(lines[greatest(1, pos - 1) : pos + 1], chr(10))
    ELSE CASE WHEN greatest(0, place - 300) > 0 THEN '…' ELSE '' END
      || trim(substring(whole, greatest(0, place - 300) + 1, least(length(whole), place + {{k}} + 300) - greatest(0, place - 300)))
      || CASE WHEN least(length(whole), place + {{k}} + 300) < length(whole) THEN '…' ELSE '' END END AS snippet,
  row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS c FROM h)
SELECT doc_id, title, matched_in, snippet, c > 20 AS truncated FROM r WHERE n <= 20
"""


@query("q1_full_text", FULL.replace("{n}", "of the").replace("{k}", "6"))
def q1_full_text(spark, d):
    return S.limited(S.full_text(sections(spark, d), "of the"), ["doc_id"], 20).select("doc_id", "title", "matched_in", "snippet", "truncated")


@query("q1_full_text_phrase", FULL.replace("{n}", "licensed under the apache").replace("{k}", "25"))
def q1_full_text_phrase(spark, d):
    return S.limited(S.full_text(sections(spark, d), "Licensed under  the Apache"), ["doc_id"], 20).select("doc_id", "title", "matched_in", "snippet", "truncated")


WANT = ("license", "idiot", "stupid")
COUNTS = "c AS (SELECT doc_id, {} AS total FROM documents WHERE text IS NOT NULL)".format(
    " + ".join(f"(length(text) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in WANT)  # these don't overlap themselves
)


@query("a1_occurrence_counts", f"WITH {COUNTS} SELECT doc_id, total FROM c WHERE total > 0")
def a1_occurrence_counts(spark, d):
    return S.occurrence_counts(table(spark, d, "documents"), WANT)


@query(
    "q4_search_mode",
    f"""WITH {COUNTS} SELECT coalesce(sum(total), 0)::BIGINT AS total, count(*) AS documents,
  CASE WHEN coalesce(sum(total), 0) > 50 THEN 'refinement_required' WHEN coalesce(sum(total), 0) <= 20 THEN 'with_context' ELSE 'occurrences' END AS mode FROM c WHERE total > 0""",
)
def q4_search_mode(spark, d):
    return S.search_mode(S.occurrence_counts(table(spark, d, "documents"), WANT), 50)


@query(
    "q4_occurrences",
    r"""WITH o AS (SELECT doc_id, text, term, unnest(list_filter(range(1, length(text) - length(term) + 2), lambda i: lower(text)[i : i + length(term) - 1] = term)) - 1 AS start
  FROM documents, (VALUES ('license'), ('idiot'), ('stupid')) t(term) WHERE contains(lower(text), term)),
p AS (SELECT *, text[1 : start] AS before FROM o)
SELECT doc_id, start, start + length(term) AS "end", string_agg(term, ',' ORDER BY term) AS terms,
  length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(string_split(before, chr(10))[-1]) + 1 AS col
FROM p GROUP BY doc_id, start, term, before""",
)
def q4_occurrences(spark, d):
    return S.occurrences(table(spark, d, "documents").where("text is not null"), WANT)


@query(
    "q5_document_occurrences",
    r"""WITH o AS (SELECT doc_id, text, term, unnest(list_filter(range(1, length(text) - length(term) + 2), lambda i: lower(text)[i : i + length(term) - 1] = term)) - 1 AS start
  FROM documents, (VALUES ('th'), ('the')) t(term) WHERE doc_id = 1)
SELECT doc_id, start, start + length(term) AS "end", string_agg(term, ',' ORDER BY term) AS terms, len(string_split(text[1 : start], chr(10))) AS line, length(string_split(text[1 : start], chr(10))[-1]) + 1 AS col
FROM o GROUP BY doc_id, start, term, text""",
)
def q5_document_occurrences(spark, d):
    """One document, without a limit."""
    return S.occurrences(table(spark, d, "documents").where("text is not null and doc_id = 1"), ["the", "th"])


@query(
    "q6_overlapping_count",
    """WITH c AS (SELECT doc_id, string_split(lower(text), '') AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(range(1, len(c) - 2), lambda i: c[i] = 't' AND c[i + 1] = 'h' AND c[i + 2] = 't' AND c[i + 3] = 'h')) AS n FROM c""",
)
def q6_overlapping_count(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.overlapping_count(F.col("text"), "thth").alias("n"))


@query(
    "q7_line_column",
    """WITH p AS (SELECT doc_id, strpos(text, 'on ') - 1 AS offs, text FROM documents WHERE strpos(text, 'on ') > 0), b AS (SELECT *, text[1 : offs] AS before FROM p)
SELECT doc_id, offs, length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(string_split(before, chr(10))[-1]) + 1 AS col FROM b""",
)
def q7_line_column(spark, d):
    at = F.instr("text", "on ") - 1
    return table(spark, d, "documents").where(at >= 0).select("doc_id", at.alias("offs"), T.line_of(F.col("text"), at).alias("line"), T.column_of(F.col("text"), at).alias("col"))


@query(
    "l4_top_titles",
    f"""WITH {COUNTS}, {LINES} SELECT doc_id, total, title FROM c JOIN s USING (doc_id) WHERE total > 0 ORDER BY total DESC, lower(title), doc_id LIMIT 50""",
)
def l4_top_titles(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return S.top_titles(S.occurrence_counts(docs, WANT), S.display_title(docs))


@query("q8_display_title", f"WITH {LINES} SELECT doc_id, CASE WHEN title = '' THEN CAST(doc_id AS VARCHAR) ELSE title END AS title FROM s")
def q8_display_title(spark, d):
    return S.display_title(table(spark, d, "documents").where("text is not null"))


@query(
    "q9_candidate_documents",
    "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)token|secret|password')",
)
def q9_candidate_documents(spark, d):
    return table(spark, d, "documents").where(F.rlike("text", F.lit("(?i)token|secret|password"))).select("doc_id")


@query(
    "q10_section_search_text",
    f"""WITH {LINES}, t AS (SELECT doc_id, lang, text, title FROM s)
SELECT doc_id, sha256(CASE WHEN contains(lower(title), lower(lang)) THEN text ELSE lang || chr(10) || text END) AS text_sha256 FROM t""",
)
def q10_section_search_text(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("lang").alias("title"), "text")
    return S.search_text(rows).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


EQ = """
WITH s AS (SELECT conv_id AS doc_id, 's' || turn AS span_id, turn AS ordinal, role AS label, text AS tex, text[1 : 80] AS context FROM conversations),
n AS (SELECT doc_id, span_id, ordinal, lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS l, span_id AS i, lower(trim(regexp_replace(tex, '\\s+', ' ', 'g'))) AS x FROM s),
r AS (SELECT doc_id, span_id, ordinal, least({cases}) AS rank, concat_ws(',', {names}) AS terms FROM n),
k AS (SELECT *, row_number() OVER (ORDER BY rank, doc_id, ordinal) AS n, count(*) OVER () AS c FROM r WHERE rank IS NOT NULL)
SELECT doc_id, span_id, ordinal, rank, terms, c > {limit} AS truncated FROM k WHERE n <= {limit}
"""


def _eq(terms, limit):
    case = lambda t: f"CASE WHEN l = '{t}' OR i = '{t}' THEN 0 WHEN contains(l, '{t}') THEN 1 WHEN contains(x, '{t}') THEN 2 END"
    return EQ.format(cases=", ".join(map(case, terms)), names=", ".join(f"CASE WHEN ({case(t)}) IS NOT NULL THEN '{t}' END" for t in terms), limit=limit)


def spans(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("span_id"), F.col("turn").alias("ordinal"), F.col("role").alias("label"), F.col("text").alias("tex"), F.lit("").alias("context"))


@query("q3_equation_terms", _eq(["s1", "assist", "thing"], 40))
def q3_equation_terms(spark, d):
    return S.equation_terms(spans(spark, d), ["s1", "assist", "thing"], 40)


@query("q2_equations", _eq(["system"], 10))
def q2_equations(spark, d):
    return S.equation_terms(spans(spark, d), ["system"], 10)


@query(
    "q11_registry_search",
    f"""WITH {LINES}, t(term) AS (VALUES ('licensed'), ('released')) SELECT term, doc_id, CASE WHEN contains(lower(title), term) THEN 'title' ELSE 'text' END AS matched_in
FROM s, t WHERE contains(lower(array_to_string(lines, ' ')), term)""",
)
def q11_registry_search(spark, d):
    parts = [S.full_text(sections(spark, d), t).select(F.lit(t).alias("term"), "doc_id", "matched_in") for t in ("licensed", "released")]
    return parts[0].unionByName(parts[1])


WORD = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w = term)"
TC = rf"""
u AS (SELECT doc_id AS unit, text, coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM documents WHERE text IS NOT NULL),
x AS (SELECT term, offs, len({WORD}) AS n, length(regexp_extract(lower(text), '^((?:.|\n)*?(?:[^\p{{L}}\p{{N}}_]|^))' || term || '(?:[^\p{{L}}\p{{N}}_]|$)', 1)) AS pos FROM u, (VALUES ('the'), ('and'), ('una'), ('der')) t(term)),
tc AS (SELECT term, sum(n)::BIGINT AS total, min(offs + pos)::BIGINT AS first FROM x WHERE n > 0 GROUP BY term)
"""


@query("a2_term_counts", f"WITH {TC} SELECT term, total, first FROM tc")
def a2_term_counts(spark, d):
    return S.term_counts(units(spark, d), TERMS)


@query("l3_top_terms", f"WITH {TC} SELECT term, total, first FROM tc ORDER BY total DESC, first, term LIMIT 3")
def l3_top_terms(spark, d):
    return S.top_terms(S.term_counts(units(spark, d), TERMS), 2)


@query(
    "w6_chapter_quota",
    """WITH c AS (SELECT lang AS chapter, sum(length(text))::BIGINT AS size FROM documents GROUP BY lang), t AS (SELECT *, count(*) OVER () AS n, sum(size) OVER () AS al FROM c),
r AS (SELECT chapter, n, greatest(97 - n, 0) AS rest, (greatest(97 - n, 0) * size) // al AS share, (greatest(97 - n, 0) * size) % al AS lft FROM t)
SELECT chapter, (1 + share + CASE WHEN row_number() OVER (ORDER BY lft DESC, chapter) <= rest - sum(share) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""",
)
def w6_chapter_quota(spark, d):
    chapters = table(spark, d, "documents").groupBy(F.col("lang").alias("chapter")).agg(F.sum(F.length("text")).alias("size"))
    return S.quotas(chapters, 97)


@query("w13_count_windows", "SELECT item_id, ((row_number() OVER (ORDER BY item_id) - 1) // 16)::BIGINT AS \"window\" FROM benchmark")
def w13_count_windows(spark, d):
    return S.windows(table(spark, d, "benchmark").select("item_id"), "item_id", 16)


@query(
    "st6_sentences",
    r"""WITH p AS (SELECT item_id AS unit, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS p FROM benchmark),
e AS (SELECT unit, unnest(range(len(p))) AS position, unnest(p) AS s FROM p)
SELECT unit, position, trim(regexp_replace(s, '\s+', ' ', 'g')) AS sentence FROM e WHERE trim(s) <> ''""",
)
def st6_sentences(spark, d):
    return S.sentences(table(spark, d, "benchmark").select(F.col("item_id").alias("unit"), "text"))


@query(
    "w12_first_sentences",
    r"""WITH p AS (SELECT item_id AS unit, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS p FROM benchmark),
e AS (SELECT unit, unnest(range(len(p))) AS position, trim(regexp_replace(unnest(p), '\s+', ' ', 'g')) AS sentence FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY unit, position) AS r FROM e WHERE contains(lower(sentence), 'the'))
SELECT unit, position, sentence FROM o WHERE r = 1 ORDER BY unit, position LIMIT 10""",
)
def w12_first_sentences(spark, d):
    rows = S.sentences(table(spark, d, "benchmark").select(F.col("item_id").alias("unit"), "text"))
    return S.first_distinct(rows.where(F.contains(F.lower("sentence"), F.lit("the"))), "sentence", ["unit", "position"], 10)
