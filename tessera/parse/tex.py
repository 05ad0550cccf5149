"""TeX: sections, formulas and stated terms."""

from __future__ import annotations

import re

from tessera.parse.markdown import Section
from tessera.parse.spans import Span, find_spans, mask

#: Commands of headings and their levels.
LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
_HEADING = re.compile(r"\\(" + "|".join(sorted(LEVELS, key=len, reverse=True)) + r")\*?(?:\[[^\]]*\])?\s*\{")
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|comment)\}.*?\\end\{\1\}", re.DOTALL)


class Unsupported(ValueError):
    """A text that refers to other files."""


def balanced(text: str, at: int) -> int:
    """The index behind the brace that closes the one at ``at``; -1 if there is none."""
    depth, i = 0, at
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        i += 1
        if depth == 0:
            return i
    return -1


def unwrap_pdfstring(text: str) -> str:
    r"""``\texorpdfstring{a}{b}`` as a, white space between the arguments or not; a use without two arguments stays.

    A second argument that isn't closed reaches to the end of the text.
    """
    name, out, done = "\\texorpdfstring", [], 0
    while (at := text.find(name, done)) >= 0:
        out.append(text[done:at])
        one = skip_white(text, at + len(name))
        if text[one : one + 1] != "{":
            done = at + len(name)
            out.append(name)
            continue
        end = balanced(text, one)
        two = skip_white(text, end) if end > 0 else len(text)
        if text[two : two + 1] == "{":
            out.append(text[one + 1 : end - 1])
            close = balanced(text, two)
            done = close if close > 0 else len(text)
        else:
            done = end if end > 0 else len(text)
            out.append(text[at:done])
    return "".join(out) + text[done:]


def skip_white(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def plain(text: str) -> str:
    """A heading's text without commands and braces."""
    text = re.sub(r"\\(?:label|footnote|thanks)\{[^{}]*\}", "", unwrap_pdfstring(text))
    text = re.sub(r"\\[A-Za-z]+\*?", " ", text)
    return " ".join(re.sub(r"[{}~$]", " ", text).split())


def masked(text: str) -> str:
    """The text with comments and verbatim parts blanked."""
    text = mask(text, [m.span() for m in _VERBATIM.finditer(text)])
    return mask(text, [m.span() for m in re.finditer(r"(?<!\\)%[^\n]*", text)])


def sections(text: str) -> list[Section]:
    """Sections from heading command to heading command; without any, one section named Document."""
    clean = masked(text)
    if re.search(r"\\(?:input|include)\s*\{", clean):
        raise Unsupported("the text includes other files")
    heads = []
    for m in _HEADING.finditer(clean):
        end = balanced(clean, m.end() - 1)
        if end > 0:
            heads.append((m.start(), LEVELS[m[1]], plain(text[m.end() : end - 1])))
    begin = re.search(r"\\begin\{document\}", clean)
    first = heads[0][0] if heads else len(text)
    body = text[begin.end() if begin else 0 : first]
    out = []
    if not heads or (begin and body.strip()):
        out.append(Section("Document", 1, 0, text.count("\n", 0, begin.end() if begin else 0) + 1, body))
    for k, (start, level, title) in enumerate(heads):
        stop = heads[k + 1][0] if k + 1 < len(heads) else len(text)
        out.append(Section(title, level, len(out), text.count("\n", 0, start) + 1, text[start:stop]))
    return out


def spans(text: str) -> list[Span]:
    return find_spans(masked(text))


def terms(text: str) -> list[str]:
    r"""Terms of ``\keywords{...}``, by commas, semicolons or ``\and``, and the items of ``theindex``."""
    clean, out = masked(text), []
    for m in re.finditer(r"\\keywords\s*\{", clean):
        end = balanced(clean, m.end() - 1)
        if end > 0:
            out += re.split(r"[,;]|\\and\b|\\sep\b", clean[m.end() : end - 1])
    for m in re.finditer(r"\\begin\{theindex\}(.*?)\\end\{theindex\}", clean, re.DOTALL):
        out += [re.sub(r",?\s*\d[\d, –-]*$", "", x.strip()) for x in re.split(r"\\(?:sub){0,2}item\b", m[1])[1:]]
    return list(dict.fromkeys(t for t in map(plain, out) if t.strip("-–— ")))
