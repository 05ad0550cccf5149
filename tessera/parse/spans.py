"""Formula spans of Markdown and TeX texts.

Forms, in the order in which they are looked for: ``$$``, display environments,
``\\[ \\]``, then ``$`` and ``\\( \\)`` inline. A span inside one that was found
before is skipped. An opening mark without its end is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Environments whose content is a displayed formula.
ENVIRONMENTS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "flalign", "alignat")
_ENVIRONMENT = re.compile(r"\\begin\{((?:" + "|".join(ENVIRONMENTS) + r")\*?)\}")
_LABEL = re.compile(r"\\label\{([^{}]*)\}")
_TAG = re.compile(r"\\tag\*?\{([^{}]*)\}")


class Unclosed(ValueError):
    """A formula, fence or environment that has no end."""


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    tex: str
    label: str | None = None


def mask(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text with the ranges blanked, line ends kept."""
    out = list(text)
    for a, b in ranges:
        for i in range(a, b):
            if out[i] != "\n":
                out[i] = " "
    return "".join(out)


def _escaped(text: str, at: int) -> bool:
    n = 0
    while at - n - 1 >= 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def find_spans(text: str) -> list[Span]:
    """All formulas of a text in which code has been masked, by the line they begin on, else in order of discovery."""
    found: list[Span] = []
    rest = text

    def take(kind: str, start: int, end: int, tex: str) -> None:
        nonlocal rest
        label = _LABEL.search(tex) or _TAG.search(tex)
        found.append(Span(kind, start, end, tex.strip(), label[1] if label else None))
        rest = mask(rest, [(start, end)])

    for opening, closing, kind in (("$$", "$$", "display"), (None, None, "display"), ("\\[", "\\]", "display"), ("$", "$", "inline"), ("\\(", "\\)", "inline")):
        at = 0
        while True:
            if opening is None:
                m = _ENVIRONMENT.search(rest, at)
                if not m:
                    break
                stop = rest.find(f"\\end{{{m[1]}}}", m.end())
                if stop < 0:
                    raise Unclosed(f"unclosed environment {m[1]}")
                end = stop + len(f"\\end{{{m[1]}}}")
                take(kind, m.start(), end, text[m.start() : end])
                at = end
                continue
            start = rest.find(opening, at)
            if start < 0:
                break
            if _escaped(rest, start):
                at = start + 1
                continue
            stop = start + len(opening)
            while True:
                stop = rest.find(closing, stop)
                if stop < 0 or not _escaped(rest, stop):
                    break
                stop += 1
            line = rest.find("\n\n", start)
            if stop < 0 or (kind == "inline" and 0 <= line < stop):
                if kind == "inline":  # a lone sign in prose
                    at = start + len(opening)
                    continue
                raise Unclosed(f"unclosed {opening}")
            end = stop + len(closing)
            if text[start + len(opening) : stop].strip():
                take(kind, start, end, text[start + len(opening) : stop])
            at = end
    return sorted(found, key=lambda s: text.count("\n", 0, s.start))
