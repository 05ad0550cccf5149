"""Search against plain loops, and what its plans may not do."""

from __future__ import annotations

import re

import pytest

from tessera.operators import matching, search, sections
from tessera.plans import all_queries

TEXTS = [
    "a\u0001b idiot \u0001", "İ idiot İİ idiot", "of  the\nof\t the of the", "x\\E y \\Q\\E", "aaaa\nxAa", "aa aa aa\naa", "", "none", None, "Straße STRASSE straße", "𝒳 of the 𝒳of the",
    "of the", "\n\nof\n\nthe\n", "K k K", "a.c abc a.c",
]
NEEDLES = ["idiot", "of the", "\\E", "aa", "aa aa", "straße", "a.c", "k"]


def plain(text: str, needle: str) -> list[tuple]:
    """(start, end, line, col) of every place where the needle matches, one character after another."""
    pattern = re.compile(r"\s+".join(map(re.escape, needle.split())), re.IGNORECASE)
    out = []
    for i in range(len(text)):
        if m := pattern.match(text, i):
            before = text[:i]
            out.append((i, m.end(), before.count("\n") + 1, i - (before.rfind("\n") + 1) + 1))
    return out


def test_occurrences_are_those_of_a_loop(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want: dict[tuple, set] = {}
    for i, t in enumerate(TEXTS):
        for n in NEEDLES:
            for hit in plain(t or "", n):
                want.setdefault((i, *hit), set()).add(n.lower())
    got = {(r.doc_id, r.start, r.end, r.line, r.col): r.terms for r in search.occurrences(docs, NEEDLES).collect()}
    assert got == {k: ",".join(sorted(v)) for k, v in want.items()}
    counts = {r.doc_id: r.total for r in search.occurrence_counts(docs, NEEDLES).collect()}
    assert counts == {i: n for i, t in enumerate(TEXTS) if (n := sum(len(plain(t or "", x)) for x in NEEDLES))}


def test_excluded_ranges_modes_and_context(spark):
    docs = spark.createDataFrame([(1, "one\ntwo the\nthree the the\nfour"), (2, "x")], "doc_id long, text string")
    ranges = spark.createDataFrame([(1, 4, 11), (2, 0, 99), (1, 19, 21)], "doc_id long, a int, b int")
    assert [r.start for r in search.occurrences(docs, ["the"], ranges).orderBy("start").collect()] == [18, 22]
    summary, hits = search.occurrence_search(docs, ["the"], 5, 1)
    assert summary.first()["mode"] == "with_context" and [r.context for r in hits.orderBy("start").limit(1).collect()] == ["one\ntwo the\nthree the the"]
    summary, hits = search.occurrence_search(docs, ["the"], 2, 1)
    assert summary.first()["mode"] == "refinement_required" and summary.first()["total"] == 3 and hits.count() == 0


@pytest.mark.parametrize("name", ["a2_term_counts", "l3_top_terms", "w10_first_occurrence"])
def test_texts_go_through_no_single_task(spark, name):
    plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    parts = [x for x in plan.split("\n") if "SinglePartition" in x]
    assert not any("text" in x for x in parts) and "Window" not in plan


def test_first_places_over_all_units(spark):
    units = spark.createDataFrame([(3, "b the"), (1, "x"), (2, "the a"), (9, "A the the")], "unit long, text string")
    got = {r.term: (r.total, r.first) for r in search.term_counts(units, ["the", "a", "zz"]).collect()}
    whole = "x the a b the A the the"
    assert got == {"the": (4, whole.index("the")), "a": (2, whole.index(" a ") + 1)}


def test_levels_beyond_six(spark):
    levels = [1, 7, 9, 7, 12, 1, 9]
    df = spark.createDataFrame([(1, i + 1, v, 7) for i, v in enumerate(levels)], "doc_id long, ordinal int, level int, last int")
    rows = {r.ordinal: r for r in sections.ends(sections.paths(sections.parents(df)), "last").collect()}
    assert [rows[i].parent for i in range(1, 8)] == [None, 1, 2, 1, 4, None, 6]
    assert [rows[i]["end"] for i in range(1, 8)] == [5, 3, 3, 5, 5, 7, 7] and rows[5].path == [1, 4, 5] and rows[7].path == [6, 7]
    many = spark.range(70).selectExpr("1L as doc_id", "int(id) as ordinal", "int(id) as level")
    with pytest.raises(ValueError, match="levels"):
        sections.parents(many)


def test_phrases_of_two_tokens(spark):
    blocks = spark.createDataFrame([(1, "Quantum Mechanics"), (2, "a bc"), (3, "Mechanics of fluids"), (4, "twice here")], "key long, text string")
    pages = spark.createDataFrame([(1, "On quantum, mechanics."), (2, "mechanics of fluids; twice here"), (3, "quantummechanics a bc twice here")], "page long, text string")
    assert {(r.key, r.page) for r in matching.phrase_pages(blocks, pages).collect()} == {(1, 1), (3, 2)}
