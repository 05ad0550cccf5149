from __future__ import annotations

import pytest

from tessera.parse import frames, html, markdown, rich, spans, tex

MD = """---
keywords: [alpha, "beta"]
---
intro $x$ and `$code$`

# One #
para \\$5 and $$y=1$$
- a
- b
  more

Two
---
```
# not
$$ open
```
| a | b |
|---|---|
| 1 | 2 |

![cap](f.png)
$$
z \\label{q}
$$
"""


def test_markdown():
    assert markdown.terms(MD) == ["alpha", "beta"]
    assert [(s.title, s.level, s.line) for s in markdown.sections(MD)] == [("Document", 1, 4), ("One", 1, 6), ("Two", 2, 12)]
    assert [(s.kind, s.label) for s in markdown.spans(MD)] == [("inline", None), ("display", None), ("display", "q")]
    assert [b.kind for b in markdown.blocks(MD)] == ["paragraph", "heading", "paragraph", "list", "heading", "code", "table", "figure", "equation"]
    assert [b.items for b in markdown.blocks(MD)][3] == ["a", "b more"]
    with pytest.raises(spans.Unclosed):
        markdown.blocks("a\n\n$$\nopen")


def test_tex():
    text = "\\keywords{one, two}\n\\begin{document}\nhi % \\section{no}\n\\section{A \\texorpdfstring{$x$}{x}}\n\\begin{align}a\\label{e}\\end{align} \\(q\\)\n\\subsection*{B}\n\\begin{verbatim}\\section{no}$$\\end{verbatim}"
    assert tex.terms(text) == ["one", "two"]
    assert [(s.title, s.level) for s in tex.sections(text)] == [("Document", 1), ("A x", 1), ("B", 2)]
    assert [(s.kind, s.label) for s in tex.spans(text) if s.tex != "x"] == [("display", "e"), ("inline", None)]
    with pytest.raises(tex.Unsupported):
        tex.sections("\\input{other}")


def test_html():
    page = "<html><head><meta name=keywords content='a, b; a'><base href='https://x.example/d/'></head><body><nav>skip</nav><article><h1>T</h1><p>one<p>two<h2>S</h2>text <script>var t='</p>'</script><img src='i.png' srcset='i.png 1x, j.png 2x'><math display=block alttext='y'><mi>z</mi></math><h1>U</h1>end<ul><li>a<ol><li>b</ol><li>c</ul></article></body>"
    assert [(s.title, s.level, s.text.split("\n")[0]) for s in html.sections(page)] == [("T", 1, "one"), ("S", 2, "text"), ("U", 1, "end")]
    assert html.terms(page) == ["a", "b"]
    assert [d[3] for d in html.dependencies(page)] == ["https://x.example/d/i.png", "https://x.example/d/j.png"]
    assert html.list_items(page) == [("1", "bullet", "a"), ("1.1", "ordered", "b"), ("2", "bullet", "c")]
    assert [(s.kind, s.tex) for s in html.spans(page)] == [("display", "y")]
    grid = html.tables("<table><tr><th rowspan=2>a<td colspan=2>b<tr><td>c<td>d</table>")
    assert grid == [[(0, 0, 2, 1, True, "a"), (0, 1, 1, 2, False, "b"), (1, 1, 1, 1, False, "c"), (1, 2, 1, 1, False, "d")]]
    with pytest.raises(ValueError, match="too_large"):
        html.tables("<table><tr><td colspan=5000>x</table>")


def test_errors_are_rows(spark):
    df = spark.createDataFrame([(1, "markdown", "# A\nx"), (2, "markdown", "$$ open"), (3, "pdf", "x"), (4, "tex", "\\input{a}"), (5, "html", None)], "doc_id long, format string, text string")
    got = {(r.doc_id, r.title, r.error) for r in frames.sections(df).collect()}
    assert got == {(1, "A", None), (2, "Document", None), (3, None, "unsupported_source"), (4, None, "unsupported_include")}
    assert {(r.doc_id, r.error) for r in frames.formulas(df.where("doc_id < 3")).collect()} == {(2, "unclosed_span")}
    assert {(r.doc_id, r.kind, r.error) for r in frames.blocks(df.where("doc_id < 3")).collect()} == {(1, "heading", None), (1, "paragraph", None), (2, None, "unclosed_span")}


RICH = """<article><h1>T</h1><h2>Abstract</h2><p>one <b>two</b> <a href="x">l</a><a href="#fn1">1</a> <math alttext="y"></math></p>loose <i>text</i>
<ul><li>a</li><li>b</li></ul><pre>x
 y</pre><p><math alttext="z"></math></p><figure><img src="i.png"><figcaption>C</figcaption></figure><table><caption>K</caption><tr><td>1<td>2</table>
<figure><img src="a"><img src="b"></figure><p><img src="s.png" alt="S"></p><aside id="fn1" class="note">body</aside></article>"""


def test_rich_html():
    got = rich.html_blocks(RICH)
    assert [(b.kind, b.text, b.role, b.caption, b.placement) for b in got] == [
        ("heading", "T", None, None, None), ("heading", "Abstract", "abstract", None, None), ("paragraph", "one two l1", None, None, None), ("paragraph", "loose text", None, None, None),
        ("list", "a\nb", "bullet", None, None), ("code", "x\n y", None, None, None), ("equation", "z", None, None, None), ("figure", "C", "single", "C", "after"), ("table", "1\t2", None, "K", "before"),
        ("figure", "", "panels", None, None), ("figure", "S", None, None, None), ("paragraph", "body", None, None, None),
    ]
    assert [s[0] for s in got[2].parts] == ["text", "mark:strong", "text", "link", "note", "text", "math"]
    assert rich.notes(RICH) == [("fn1", "1", "body")]
    head = "<meta name=citation_author content='A B'><meta name=citation_author_institution content=U><meta name=citation_author_orcid content='0000-0001-2345-678X'><meta name=citation_author content=C>"
    assert rich.authors(head) == [(0, "A B", "0000-0001-2345-678X", ["U"]), (1, "C", None, [])]


def test_rich_tex():
    text = r"""\begin{document}\begin{abstract}An \emph{a} $x$.\end{abstract}
\section{Acknowledgements}
One.

Two % c
\begin{enumerate}\item a \item b\end{enumerate}\begin{align*}q\end{align*}\[r\]
\begin{figure}\includegraphics[w]{f.png}\caption{A \textbf{c}}\end{figure}\begin{table}\begin{tabular}{cc}1 & 2 \\ \hline 3 & 4\end{tabular}\caption{K}\end{table}
\begin{verbatim}\section{no}\end{verbatim}\end{document}"""
    got = [(b.kind, b.text, b.role, b.caption) for b in rich.tex_blocks(text)]
    assert got == [
        ("heading", "Abstract", "abstract", None), ("paragraph", "An a $x$ .", None, None), ("heading", "Acknowledgements", "acknowledgements", None), ("paragraph", "One.", None, None), ("paragraph", "Two", None, None),
        ("list", "a\nb", "ordered", None), ("equation", "q", None, None), ("equation", "r", None, None), ("figure", "A c", "single", "A c"), ("table", "1\t2\n3\t4", None, "K"), ("code", "\\section{no}", None, None),
    ]
    with pytest.raises(spans.Unclosed):
        rich.tex_blocks("\\begin{align}x")


def test_targets_are_rewritten_by_place():
    from tessera.parse.rewrite import Mismatch, embedded, rewritten

    page = "<script>'<img src=\"s\">'</script><img SRC=a.png><source srcset='x 1x, y 2x' src=\"m\"><p src=no><object data=\"d&amp;e\">"
    assert [(e, a, t) for e, a, t, *_ in embedded(page)] == [("img", "src", "a.png"), ("source", "src", "m"), ("source", "srcset", "x 1x, y 2x"), ("object", "data", "d&e")]
    record = lambda n, e, a, t, p: {"ordinal": n, "element": e, "attribute": a, "target": t, "path": p}
    text, n = rewritten(page, [record(0, "img", "src", "a.png", 'l"1'), record(3, "object", "data", "d&e", "l&2"), record(1, "source", "src", "m", None)])
    assert n == 2 and text == page.replace("SRC=a.png", 'SRC="l&quot;1"').replace('"d&amp;e"', '"l&amp;2"')
    assert rewritten("<p>", []) == ("<p>", 0)
    for bad in ([record(0, "img", "src", "b.png", "x")], [record(9, "img", "src", "a.png", "x")], [record(k, "img", "src", "a.png", "x") for k in range(5)]):
        with pytest.raises(Mismatch):
            rewritten(page, bad)
