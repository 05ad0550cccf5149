"""Licence scan by sentence rules.

Texts are cut into sentences, once with line ends as cuts, once across lines
(for wrapped licence texts) and once across the lines of each paragraph, and
normalised. Parts of known sentences have marks; a known sentence is found
where its marks stand side by side, as those of "free software: you can ...",
which a sentence end cuts. At each place the longest one counts. It has an
identifier; the identifiers of a document, in order, are matched against
ordered rules, each of which names a licence and a sequence of identifiers that
must occur in that order (others may stand between). A rule is skipped if one
that covers it has matched.

Only DataFrame functions are used, without any shuffle: sentences and rules are
a library (a parameter) of a small, fixed size, and texts without any part of a
word that every known sentence has one of are not cut at all.

Defined results: null and empty texts have no sentences and no licence;
repeated rows are scanned each for itself; null ids are kept; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, lower_az, table
from tessera.llm.license_library import END, LIBRARY, OTHER, Library

#: Line ends around lines without a letter or digit, as comment signs stay on blank lines.
_BLANK = r"\n[^a-z0-9]*\n"
#: The mark of sentences that aren't known.
_UNKNOWN = "<->"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _any(library: Library) -> str:
    """Matches the marks of any known sentence, longer ones first."""
    return "|".join(library.runs)


def _known(text: Column, library: Library) -> Column:
    """Identifiers of the known sentences of a lower-cased text, in order."""
    said = F.transform(F.split(F.regexp_replace(text, END, "\n"), "\n", -1), lambda s: F.trim(F.regexp_replace(s, OTHER, " ")))
    marks = F.transform(F.filter(said, lambda s: s != ""), lambda s: F.coalesce(F.try_element_at(_map(library.marks), s), F.lit(_UNKNOWN)))
    found = F.regexp_extract_all(F.array_join(marks, ""), F.lit(_any(library)), 0)
    return F.transform(found, lambda m: F.element_at(_map(library.runs), m))


def _has(text: Column, anchors: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(anchors[0]))
    for a in anchors[1:]:
        out = out | F.contains(text, F.lit(a))
    return out


def _pattern(ids: tuple[str, ...]) -> str:
    """Matches ',a,b,c,' if the identifiers occur in order."""
    return "," + ",(.*,)?".join(i.replace(".", "[.]") for i in ids) + ","


def scan(docs: DataFrame, library: Library = LIBRARY) -> DataFrame:
    """doc_id, sentence_ids (in order, by lines, then those found only across lines, then those only within paragraphs), rules and licences, as arrays."""
    text = lower_az(F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    lower = docs.select("doc_id", text.alias("t")).withColumn("near", _has(F.col("t"), library.anchors))
    one_line = lambda c: F.translate(c, "\n", " ")
    readings = {
        "by_line": F.when(F.col("near"), _known(F.col("t"), library)),
        "across": F.when(F.col("near"), _known(one_line("t"), library)),
        "paragraphs": F.when(F.col("near") & F.rlike("t", F.lit(_BLANK)), _known(one_line(F.regexp_replace("t", _BLANK, ".\n")), library)),
    }
    found = lower.select("doc_id", *(c.otherwise(none).alias(name) for name, c in readings.items()))
    in_lines = F.concat("by_line", F.array_except("across", "by_line"))
    ids = found.select("doc_id", F.concat(in_lines, F.array_except("paragraphs", in_lines)).alias("sentence_ids"), *(
        F.concat(F.lit(","), F.array_join(c, ","), F.lit(",")).alias(f"s_{c}") for c in readings))
    raw = F.array_compact(F.array(*(
        F.when(F.rlike("s_by_line", p) | F.rlike("s_across", p) | F.rlike("s_paragraphs", p), F.lit(rule))
        for rule, p in ((r, F.lit(_pattern(sequence))) for r, _, sequence, _ in library.rules))))
    matched = ids.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, raw).otherwise(none).alias("raw"))
    covers = _map({r: "," + ",".join(c) + "," for r, _, _, c in library.rules})
    stands = F.filter("raw", lambda r: ~F.exists("raw", lambda c: F.contains(F.element_at(covers, r), F.concat(F.lit(","), c, F.lit(",")))))
    rules = matched.select("doc_id", "sentence_ids", F.when(F.size("raw") > 0, stands).otherwise(none).alias("rules"))
    licence = _map({r: n for r, n, _, _ in library.rules})
    return rules.select("*", F.array_distinct(F.transform("rules", lambda r: F.element_at(licence, r))).alias("licences"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the default library."""
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), *(F.array_join(c, ",").alias(c) for c in ("sentence_ids", "rules", "licences")))


def sql(library: Library = LIBRARY) -> str:
    """The same rows, without the check for parts of words."""
    marks = ", ".join(f"('{s}', '{m}')" for s, m in library.marks.items())
    runs = ", ".join(f"('{m}', '{i}')" for m, i in library.runs.items())
    rules = ", ".join(f"({k}, '{r}', '{n}', '{_pattern(s)}', [{', '.join(repr(c) for c in cov)}]::VARCHAR[])" for k, (r, n, s, cov) in enumerate(library.rules))
    cut = lambda t: f"string_split(regexp_replace({t}, '{END}', chr(10), 'g'), chr(10))"
    return rf"""
WITH marks(s, mark) AS (VALUES {marks}),
runs(run, id) AS (VALUES {runs}),
rules(k, rule, licence, pattern, covered) AS (VALUES {rules}),
d AS (SELECT doc_id, row_number() OVER () AS n, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
texts AS (
  SELECT n, 0 AS how, {cut("t")} AS p FROM d
  UNION ALL SELECT n, 1, {cut("replace(t, chr(10), ' ')")} FROM d
  UNION ALL SELECT n, 2, {cut(f"replace(regexp_replace(t, '{_BLANK}', '.' || chr(10), 'g'), chr(10), ' ')")} FROM d),
said AS (SELECT n, how, i, trim(regexp_replace(s, '{OTHER}', ' ', 'g')) AS s FROM (SELECT n, how, unnest(p) AS s, unnest(range(len(p))) AS i FROM texts)),
marked AS (SELECT n, how, string_agg(coalesce(mark, '{_UNKNOWN}'), '' ORDER BY i) AS m FROM said LEFT JOIN marks USING (s) WHERE s <> '' GROUP BY n, how),
found AS (SELECT n, how, unnest(r) AS run, unnest(range(len(r))) AS i FROM (SELECT n, how, regexp_extract_all(m, '{_any(library)}') AS r FROM marked)),
known AS (SELECT n, how, i, id FROM found JOIN runs USING (run)),
firsts AS (SELECT k.n, how, i, id, min(how) OVER (PARTITION BY k.n, id) AS least, row_number() OVER (PARTITION BY k.n, how, id ORDER BY i) AS r FROM known k),
ids AS (SELECT n, string_agg(id, ',' ORDER BY how, i) AS sentence_ids, count(*) AS c FROM firsts WHERE how = least AND (how = 0 OR r = 1) GROUP BY n),
seq AS (SELECT n, how, ',' || string_agg(id, ',' ORDER BY i) || ',' AS q FROM known GROUP BY n, how),
raw AS (SELECT DISTINCT n, r.k, rule, licence, covered FROM seq JOIN rules r ON regexp_matches(q, pattern)),
hit AS (SELECT * FROM raw a WHERE NOT EXISTS (SELECT 1 FROM raw b WHERE b.n = a.n AND list_contains(a.covered, b.rule))),
named AS (SELECT n, min(k) AS k, licence FROM hit GROUP BY n, licence),
r AS (SELECT n, string_agg(rule, ',' ORDER BY k) AS rules FROM hit GROUP BY n),
l AS (SELECT n, string_agg(licence, ',' ORDER BY k) AS licences FROM named GROUP BY n)
SELECT doc_id, coalesce(c, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licences, '') AS licences
FROM d LEFT JOIN ids USING (n) LEFT JOIN r USING (n) LEFT JOIN l USING (n)
"""


SQL = sql()
