from __future__ import annotations

import io
import zipfile

import pytest

from tessera.operators import blocks
from tessera.sources import containers


def test_outline(spark):
    df = spark.createDataFrame([(1, '[{"title": "A", "page": 1, "kids": [{"title": "B"}]}, {"title": "C", "page": 9}]'), (2, None)], "doc_id long, outline string")
    got = [(r.path, r.title, r.level, r.parent, r.page, r.has_children) for r in containers.outlines(df).collect()]
    assert got == [("0", "A", 1, None, 1, True), ("0.0", "B", 2, "0", None, False), ("1", "C", 1, None, 9, False)]


def book(**extra) -> bytes:
    files = {
        "META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
        "o/p.opf": '<package xmlns="p"><manifest><item id="b" href="b%20x.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/></manifest><spine><itemref idref="a"/><itemref idref="i"/><itemref idref="b"/></spine></package>',
        "o/a.xhtml": "<p>one</p><script>no</script>", "o/b x.xhtml": "<style>x</style><p>two</p>",
    } | extra
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_books(spark):
    df = spark.createDataFrame([(1, book()), (2, b"no zip"), (3, book(**{"../x": "y"}))], "doc_id long, payload binary")
    got = {(r.doc_id, r.path, r.html, r.error) for r in containers.books(df).collect()}
    assert got == {(1, "o/a.xhtml", "<p>one</p>", None), (1, "o/b x.xhtml", "<p>two</p>", None), (2, None, None, "invalid_book"), (3, None, None, "unsafe_path")}


def test_streams_split_anywhere(spark):
    whole = {
        1: b'{"type": "text", "text": "a"}\n{"type": "result", "text": "R"}\n{"type": "completed"}', 2: b'{"type": "interrupted"}\n{"type": "failed"}\n{"type": "interrupted"}\n',
        3: b'{"type": "result"}\n{"type": "result"}\nbad\n{"type": "completed"}\n', 4: b'{"type": "result", "text": "x"}\n',
    }
    rows = [(t, i, d[i : i + 1]) for t, d in whole.items() for i in range(len(d))]
    got = {r.task_id: (r.status, r.text, r.bad) for r in containers.accumulated(spark.createDataFrame(rows, "task_id long, chunk_index int, data binary")).collect()}
    assert got == {1: ("completed", "R", 0), 2: ("failed", None, 0), 3: ("conflict", None, 1), 4: ("incomplete", None, 0)}


def test_repairs():
    assert blocks.repair("a xx b", "xx", [("math", "y")]) == [("text", "a "), ("math", "y"), ("text", " b")]
    assert blocks.repair("a xx b", "xx", [("text", "y")]) == [("text", "a y b")]
    for bad in ("zz", " ", ""):
        with pytest.raises(blocks.NotUnique):
            blocks.repair("a  xx b b", bad, [("text", "y")])
    text, spans = blocks.inline([("text", " a  b "), ("math", " x "), ("text", "  c\n")])
    assert text == "a b x c" and [text[s:e] for s, e, _ in spans] == ["a b ", "x", " c"]
    assert blocks.semantic_key({"a": 1, "new": False}, {"new": False}) == blocks.semantic_key({"a": 1}, {"new": False}) != blocks.semantic_key({"a": 1, "new": True}, {"new": False})


def test_groupings(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([None, "1", None, None, "2", None])], "doc_id long, row int, tag string")
    assert [r.group for r in blocks.equation_rows(rows).orderBy("row").collect()] == [1, 1, 1, 4, 4, 4]
    units = spark.createDataFrame([(1, "emitted"), (1, "opaque"), (1, None), (2, "excluded")], "doc_id long, disposition string")
    assert {tuple(r) for r in blocks.visible_content(units).collect()} == {(1, 1, 0, 1, 1), (2, 0, 1, 0, 0)}
    schema = "block_id long, kind string, text string, anchors array<struct<s: int, e: int, m: string>>"
    before = spark.createDataFrame([(1, "p", "", None), (2, "p", "", None), (3, "p", "", None)], schema)
    after = spark.createDataFrame([(1, "p", "see *", [(4, 5, "*")]), (2, "h", "", []), (4, "p", "", []), (3, "p", "x", [(0, 1, "*")])], schema)
    assert {tuple(r) for r in blocks.revision_errors(before, after).collect()} == {(2, "kind"), (4, "added"), (3, "anchor")}
