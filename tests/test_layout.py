from __future__ import annotations

import json

import pytest

from tessera.operators import finish
from tessera.operators import ocr as O
from tessera.parse import meaning
from tessera.parse import ocr as items

HEADER = "doc_id long, page int, width double, height double, box array<double>, text string"
ITEM = "doc_id long, page int, ordinal int, type string, text string, level int, box array<double>"
LABEL = (1, 0, 1000.0, 1000.0, [10.0, 10.0, 60.0, 50.0], " Article ")
ICON, TITLE = (1, 0, 3, "image", None, None, [20.0, 60.0, 90.0, 120.0]), (1, 0, 4, "text", "T", 1, [100.0, 70.0, 900.0, 110.0])


@pytest.mark.parametrize(("headers", "rows", "want"), [
    ([LABEL], [ICON, TITLE], [(3, "Article")]),
    ([LABEL, (*LABEL[:5], "ARTICLE")], [ICON, TITLE], []),  # not unique
    ([LABEL], [ICON, (*ICON[:2], 5, *ICON[3:]), TITLE], []),  # two images
    ([LABEL], [ICON, (*TITLE[:5], 2, TITLE[6])], []),  # no title
    ([LABEL], [ICON, TITLE, (1, 0, 1, "text", "Article", None, None)], []),  # said already
    ([(*LABEL[:5], "12")], [ICON, TITLE], []),  # no letter
    ([(*LABEL[:4], [10.0, 10.0, 60.0, 251.0], "Article")], [ICON, TITLE], []),
    ([(*LABEL[:4], [10.0, 10.0], "Article"), (*LABEL[:4], None, "x"), (1, 0, 0.0, 1.0, LABEL[4], "y")], [ICON, TITLE], []),
    ([LABEL], [(*ICON[:6], [20.0, 60.0, 141.0, 120.0]), TITLE], []),  # too wide
    ([LABEL], [(*ICON[:6], [20.0, 101.0, 90.0, 130.0]), TITLE], []),  # too far
    ([LABEL], [], []), ([], [ICON, TITLE], []),
])
def test_title_labels(spark, headers, rows, want):
    got = O.title_labels(spark.createDataFrame(headers, HEADER), spark.createDataFrame(rows, ITEM)).collect()
    assert [(r.before, r.text) for r in got] == want


def span(content, cross=None, kind="text"):
    return ([0.0, 0.0, 1.0, 1.0], kind, content, cross)


def line(*spans, starts=None):
    return ([0.0, 0.0, 2.0, 2.0], starts, list(spans))


BLOCK = f"doc_id long, page int, ordinal int, kind string, box array<double>, index int, deleted boolean, lines {O.LINES}, width double, height double"
ORIGINAL = f"doc_id long, page int, kind string, box array<double>, index int, lines {O.LINES}"
SAID = "doc_id long, item long, page int, box array<double>, text string"
BOX, THOUSANDTHS = [1.0, 2.0, 3.0, 4.0], [10.0, 20.0, 30.0, 40.0]


def merged(**change):
    a, b = line(span("so-")), line(span("called $5"))
    case = {
        "blocks": [(1, 0, 0, "text", BOX, None, False, [a, line(span("called $5", True))], 100.0, 100.0), (1, 1, 0, "text", BOX, None, True, [], 100.0, 100.0)],
        "originals": [(1, 0, "text", BOX, 7, [a]), (1, 1, "text", BOX, 7, [b])],
        "items": [(1, 10, 0, THOUSANDTHS, r"socalled \$5"), (1, 11, 1, THOUSANDTHS, "")],
    }
    return case | change


@pytest.mark.parametrize(("case", "want"), [
    (merged(), {(10, "so-"), (11, r"called \$5")}),
    (merged(items=[(1, 10, 0, THOUSANDTHS, "so-"), (1, 11, 1, THOUSANDTHS, r"called \$5")]), {(10, "so-"), (11, r"called \$5")}),
    (merged(items=[(1, 10, 0, THOUSANDTHS, "else"), (1, 11, 1, THOUSANDTHS, "")]), {"other_text"}),
    (merged(items=[(1, 10, 0, THOUSANDTHS, "x"), (1, 12, 0, THOUSANDTHS, "x")]), {"no_item"}),
    (merged(originals=merged()["originals"][:1]), {"no_original"}),
    (merged(originals=merged()["originals"] + merged()["originals"][1:]), {"no_original"}),
    (merged(originals=[(1, 0, "text", BOX, 7, [line(span("so"))]), merged()["originals"][1]]), {"other_lines"}),
    (merged(blocks=[(*merged()["blocks"][0][:7], [line(span("so-")), line(span("called $5"))], 100.0, 100.0), merged()["blocks"][1]]), {"other_marks"}),
    (merged(blocks=merged()["blocks"][1:]), {"no_owner"}),
    (merged(blocks=[(1, 0, 0, "table", BOX, None, True, [], 1.0, 1.0)]), {"unsupported_kind"}),
    (merged(blocks=[(*merged()["blocks"][0][:7], [line(span("a"))], 100.0, 100.0)]), set()),  # nothing merged
    (merged(blocks=[]), set()),
])
def test_page_texts(spark, case, want):
    df = O.page_texts(*(spark.createDataFrame(case[n], s) for n, s in (("blocks", BLOCK), ("originals", ORIGINAL), ("items", SAID))))
    assert {r.error or (r.item, r.text) for r in df.collect()} == want


def test_line_text():
    lines = lambda *x: [{"spans": [{"kind": k, "content": c} for k, c in spans], "starts_item": s} for s, *spans in x]
    assert O.line_text(lines((None, ("text", "ab-")), (None, ("text", "cd"))), True) == "abcd"
    assert O.line_text(lines((None, ("text", "ab-")), (None, ("text", "Cd"))), True) == "ab-Cd"
    assert O.line_text(lines((None, ("text", "ab")), (True, ("text", "cd"))), True) == "ab   \ncd"
    assert O.line_text(lines((None, ("text", "ab")), (None, ("text", "cd"))), False) == "abcd"
    assert O.line_text(lines((None, ("inline_equation", "x"), ("inline_equation", ""), ("text", r"Ａ\*_"))), True) == r"$x$ A\*\_"
    assert O.line_text(lines((None, ("text", "# no"))), True) == r"\# no"
    assert O.line_text([], True) == ""


def test_items():
    html = lambda **i: items.item_html(i, 1, 2, {"i.png": "assets/i.png"})
    assert html(type="text", text=r"\# a \_ $x<1$ $5") == ('<p id="pdf-p1-b2-n0"># a _ <math alttext="x&lt;1"></math> $5</p>', "included", ["pdf-p1-b2-n0"], [])
    assert html(type="text", text=" ")[:2] == ("", "unavailable") and html(type="header", text="x")[:2] == ("", "excluded")
    assert html(type="equation", text="", img_path="i.png")[0] == '<figure id="pdf-p1-b2-n0"><img src="assets/i.png" alt=""></figure>'
    assert html(type="list", list_items=["a", " ", "b"])[0] == '<ul><li id="pdf-p1-b2-n0">a</li><li id="pdf-p1-b2-n1">b</li></ul>'
    assert html(type="code", code_body="```py\na < b\n```", code_caption="c")[0] == '<p id="pdf-p1-b2-n0">c</p>\n<pre id="pdf-p1-b2-n1"><code class="language-py">a &lt; b</code></pre>'
    table = html(type="table", table_body='<table class="x"><tr><td colspan="2"><script>1</script>$y$</td></tr></table>tail', table_caption=["T"], table_footnote=["f"])
    assert table[0] == '<table id="pdf-p1-b2-n0"><caption>T</caption><tr><td colspan="2"><math alttext="y"></math></td></tr></table>\n<p id="pdf-p1-b2-n1">tail</p>\n<p id="pdf-p1-b2-n2">f</p>'
    assert table[3] == ["markup_removed"]
    assert html(type="table", table_body="words", table_caption=["T"])[3] == ["no_table"]
    assert html(type="new", text="t")[1] == "plain_fallback" and html(type="new")[1] == "unavailable"
    with pytest.raises(items.BadText):
        html(type="text", text="\x01")


def test_items_of_awkward_rows(spark):
    rows = [(1, 0, 1, "no json", None), (1, 1, 1, "[]", {}), (None, 2, 1, json.dumps({"type": "text", "text": 1}), {}), (2, 0, 1, None, {})]
    got = items.render_items(spark.createDataFrame(rows, "doc_id long, ordinal long, page long, item string, images map<string,string>")).collect()
    assert [(r.status, r.notes) for r in got] == [("invalid", ["no_object"]), ("invalid", ["no_object"]), ("invalid", ["invalid_text"]), ("invalid", ["no_object"])]


def test_heading_roles():
    of = lambda t: [r[2:] for r in meaning.heading_roles(t)]
    assert of('<section><h4>p</h4><section><h5 class="ltx_title_acknowledgements">t</h5></section></section>') == [(4, None, None), (5, "acknowledgements", None)]
    assert of('<section><div><h5 class="ltx_title_acknowledgements">t</h5></div></section>') == [(None, None, "no_parent")]
    assert of('<section><h2>a</h2><h2>b</h2><h5 class="ltx_title_acknowledgements">t</h5></section>')[2] == (None, None, "several_parents")
    assert of('<section><h6>a</h6><h6 class="ltx_title_acknowledgements">t</h6></section>')[1] == (None, None, "too_deep")
    assert of('<div class="ltx_abstract"><div class="ltx_abstract"><h2>t</h2></div></div>') == [(None, None, "nested_part")]
    assert of('<div class="ltx_keywords"><div class="ltx_abstract"><h2>t</h2></div></div>') == [(None, None, "conflicting_roles")]
    assert of("") == []


def test_equations_captions_panels():
    assert meaning.equations("<table><tr><td>x</td></tr></table>") == []
    row = '<tr><td><math alttext="{}"></math></td>{}</tr>'.format
    tag = '<td class="ltx_tag">( 3 )</td>'
    assert meaning.equations(f"<table>{row('a', tag)}{row('b', '')}{row('c', tag.replace('3', '4'))}</table>") == [(0, "a b", "3"), (1, "c", "4")]
    assert meaning.captions("<figure><figcaption>x</figcaption></figure>")[0][3:] == (None, None, "no_content")
    assert meaning.captions("<figure><figcaption>x</figcaption><img><figcaption>y</figcaption></figure>")[0][5] == "several_captions"
    assert meaning.captions('<table><caption style="text-align: left">x</caption><tr><td>1</td></tr></table>')[0][3:] == ("embedded", None, None)
    assert meaning.panels('<figure><div class="ltx_flex_figure"><div class="ltx_flex_cell ltx_flex_size_1"><img src="a"></div><div class="ltx_flex_break"></div></div></figure>')[0][9] == "bad_break"
    assert meaning.panels("<figure><p>none</p></figure>") == []


def test_drawings():
    assert meaning.drawing_slices("a<svg/>b<SVG><svg></svg></SVG>") == [(1, 7), (8, 30), (13, 24)]
    assert meaning.drawing_slices("<svg>") == meaning.drawing_slices("</svg>") == []
    assert meaning.drawing_slices("<!-- <svg> --><script>'<svg>'</script>") == []
    got = meaning.standalone('<svg xmlns="n"><a href=" javascript:x" ONCLICK="y" id=\'q\'>t</a><foreignObject><p>gone</p></foreignObject><style>a{b:c}</style><style>@import "x"</style><linearGradient/></svg>')
    assert got == '<svg xmlns="n"><a id=\'q\'>t</a><style>a{b:c}</style><linearGradient/></svg>'
    assert [d[:3] for d in meaning.drawings("<svg><svg></svg></svg><svg/>")] == [(0, 0, 22), (1, 22, 28)]


PAGE = "doc_id long, page int, size long, expected int, status string"
ENTRY = "doc_id long, ordinal int, page int, box array<double>, status string, source_ids array<string>"


@pytest.mark.parametrize(("page", "entries", "want"), [
    ((5, 1), [("included", ["a"])], "parsed"), ((5, 2), [("included", ["a"])], "partial"), ((5, 1), [("excluded", [])], "unavailable"),
    ((5, 0), [], "empty"), ((None, 0), [], "unavailable"), ((5, None), [("included", ["a"])], "partial"), ((5, 1), [("included", ["a"]), ("unavailable", [])], "partial"),
])
def test_page_status(spark, page, entries, want):
    pages = spark.createDataFrame([(1, 1, *page, "x")], PAGE)
    rows = spark.createDataFrame([(1, i, 1, None, *e) for i, e in enumerate(entries)], ENTRY)
    assert [r.status for r in O.page_status(pages, rows).collect()] == [want]


def test_bundles(spark):
    pages = spark.createDataFrame([(1, 1, 5, 1, "parsed"), (1, 2, 5, 0, "parsed")], PAGE)
    entries = spark.createDataFrame([(1, 0, 1, None, "included", ["a"]), (1, 2, 3, [2.0, 0.0, 1.0, 1.0], "excluded", ["a"]), (1, 3, 1, None, "included", [])], ENTRY)
    files = spark.createDataFrame([(1, "resource", "../x", 1, "0", True, None), (1, "source", "s", 2, "0", False, b"s"), (1, "source", "s", 2, "0", False, b"s")], "doc_id long, role string, path string, size long, sha256 string, rendered boolean, payload binary")
    anchors = spark.createDataFrame([(1, "z"), (1, "z")], "doc_id long, id string")
    images = spark.createDataFrame([(1, "y")], "doc_id long, src string")
    got = {r.rule for r in O.bundle_errors(pages, entries, files, anchors, images).collect()}
    assert got == {"entry_gap", "page_status", "page_of_entry", "box", "excluded_with_anchor", "included_without_anchor", "anchor_again", "anchor_not_in_source", "id_again", "path_again", "unsafe_path", "file_missing", "file_differs", "image_not_bound", "image_not_shown"}


def test_notes(spark):
    schema = "doc_id long, ordinal int, note_id string, source_id string, marker string, body string, block_id string, place int, start int, end int"
    targets = spark.createDataFrame([(1, "b", 0, 0, "x1 y"), (1, "c", 1, 0, None)], "doc_id long, block_id string, b_ordinal int, place int, text string")
    notes = [(1, 0, "n", "", "1", "t", "b", 0, 1, 2), (1, 1, "m", "k", "x", "t", "b", 0, 0, 1), (1, 3, "o", "", "y", "", "b", 0, 3, 5), (1, 4, "p", "", "y", "t", "c", 0, 0, 1)]
    got = {(r.ordinal, r.rule) for r in O.note_errors(spark.createDataFrame(notes, schema), targets).collect()}
    assert got == {(1, "source_id"), (1, "order"), (3, "ordinal"), (3, "body"), (3, "anchor"), (4, "ordinal"), (4, "part")}


def test_finished_documents(spark):
    schema = "doc_id long, source string, ordinal int, kind string, level int, text string, payload string, source_id string"
    rows = [(1, "s", 0, "paragraph", None, "p", "p", ""), (1, "s", 1, "heading", 2, "a", "a", "x"), (1, "s", 2, "heading", 4, "b", "b", "y"), (1, "s", 3, "table", None, "t", "t", "y"), (1, "s", 4, "heading", 1, "c", "c", ""), (2, "s", 0, "heading", 3, "d", "d", "z")]
    blocks = spark.createDataFrame(rows, schema)
    tree = finish.section_tree(blocks)
    got = {(r.doc_id, r.title): (r.first, r.last, len(r.path), r.path[-1] == r.section_id) for r in tree.collect()}
    assert got == {(1, "Document"): (0, 4, 1, True), (1, "a"): (1, 4, 2, True), (1, "b"): (2, 4, 3, True), (1, "c"): (4, 5, 1, True), (2, "d"): (0, 1, 1, True)}
    whole = finish.with_identity(blocks, tree)
    assert [len(r.path) for r in whole.orderBy("doc_id", "ordinal").collect()] == [1, 2, 3, 3, 1, 1]
    targets = finish.target_manifest(whole, tree)
    assert {(r.doc_id, r.alias, r.kind, r.first, r.last) for r in targets.collect()} == {(1, "x", "section", 1, 4), (2, "z", "section", 0, 1)}
    kept, lost = finish.admitted(targets, spark.createDataFrame([(1, "alias"), (1, "range")], "doc_id long, rule string"))
    assert [r.doc_id for r in kept.collect()] == [2] and [tuple(r) for r in lost.collect()] == [(1, 2)]
    assert finish.section_tree(blocks.limit(0)).count() == 0
