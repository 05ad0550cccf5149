"""Text functions on columns; all are built-in expressions and stay inside generated code.

A null input gives null. ``(?U)`` makes the patterns cover letters and digits of
all scripts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized(text: Column, case_sensitive: bool = False) -> Column:
    """The form in which titles, texts and needles are compared."""
    out = collapse(text)
    return out if case_sensitive else F.lower(out)


def fingerprint(text: Column) -> Column:
    """Lower-cased runs of letters and digits, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")


def math_fingerprint(text: Column) -> Column:
    """Letters, digits and operators only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_=+*/^-]", "")


def strip_section_number(title: Column) -> Column:
    """The title without one leading decimal, Roman or single-letter label."""
    return F.regexp_replace(title, r"^\s*(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.)\s+", "")


def outline_title(title: Column) -> Column:
    """A title of an outline without its chapter label and trailing page number, as a fingerprint."""
    bare = F.regexp_replace(strip_section_number(F.regexp_replace(title, r"^(?i:chapter|section|part)\s+[0-9IVXLC]+[.:]?\s*", "")), r"[\s.]*\d+\s*$", "")
    return fingerprint(bare)


def letters_only(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z]", "")


#: Titles of sections that list terms.
TERM_TITLES = ("keyword", "keywords", "keyterms", "index", "subjectindex", "indexterms")


def is_term_title(title: Column) -> Column:
    return letters_only(title).isin(*TERM_TITLES)


def alphanumerics(text: Column) -> Column:
    """How many letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def is_substantive(text: Column) -> Column:
    """Ten letters or digits at least, and not an empty container."""
    return (alphanumerics(text) >= 10) & ~F.trim(text).isin("{}", "[]")


def looks_like_equation(line: Column) -> Column:
    """A line with an operator, and a printed number at its end or few words."""
    operator = F.rlike(line, F.lit(r"[=<>+*/^≤≥≈∑∫-]"))
    numbered = F.rlike(line, F.lit(r"\(\d+(?:\.\d+)*\)\s*$"))
    return operator & (numbered | (F.size(F.split(F.trim(line), r"\s+")) <= 24))


def has_page_evidence(fp: Column) -> Column:
    """Two tokens and eight letters or digits of a fingerprint at least."""
    return (F.size(F.split(fp, " ")) >= 2) & (F.length(F.replace(fp, F.lit(" "))) >= 8)


def first_line(text: Column) -> Column:
    """The first line that isn't blank, collapsed."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return collapse(F.try_element_at(lines, F.lit(1)))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - (F.length(before) - F.coalesce(F.nullif(F.instr(F.reverse(before), "\n"), F.lit(0)) - 1, F.length(before))) + 1


def clip(text: Column, start: Column, end: Column, width: int = 400) -> Column:
    """At most ``width`` characters around a match, marked where cut."""
    room = F.greatest(F.lit(0), F.lit(width) - (end - start))
    a = F.greatest(F.lit(0), F.least(start - F.floor(room / 2), F.length(text) - width)).cast("int")
    b = F.least(F.length(text), a + width).cast("int")
    cut = F.trim(F.substring(text, a + 1, b - a))
    return F.when(F.length(text) <= width, text).otherwise(
        F.concat(F.when(a > 0, F.lit("…")).otherwise(""), cut, F.when(b < F.length(text), F.lit("…")).otherwise(""))
    )


#: Names of fields that hold secrets, and shapes of keys.
SECRET_NAMES = r"(?:[a-z][a-z0-9]*_)*(?:api[-_]?key|authorization|cookie|credential|password|passwd|refresh[-_]?token|secret|set-cookie|token|x-api-key|access[-_]?token)"
SECRET_SHAPES = (
    r"\bsk-[A-Za-z0-9_-]{8,}\b",
    r"\b(?:gh[opusr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{16,})\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{30,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
)


#: Fixed value: credentials behind the name of their scheme.
SCHEMES = r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+"


def redaction_steps(backref: str = "$") -> list[tuple[str, str]]:
    """Patterns and replacements, in order; without look-around, so that other engines can run them."""
    one = f"{backref}1"
    head = rf"(?i)([\"']?{SECRET_NAMES}[\"']?\s*[:=]\s*)"
    return [
        (SCHEMES, f"{one} [REDACTED]"),
        (rf'{head}"[^\r\n"]*"', f"{one}[REDACTED]"),
        (rf"{head}'[^\r\n']*'", f"{one}[REDACTED]"),
        (rf"{head}[^\s,;}}]+", f"{one}[REDACTED]"),
        *((s, "[REDACTED]") for s in SECRET_SHAPES),
    ]


#: Every credential that is redacted has one of these, in lower case.
SECRET_HINTS = ("bearer", "basic", "key", "authorization", "cookie", "credential", "passw", "secret", "token", "sk-", "gho_", "ghp_", "ghu_", "ghs_", "ghr_", "github_pat_", "akia", "aiza", "xox")


def redact(text: Column) -> Column:
    """Credentials of common forms replaced by a mark; texts without any hint of one skip the patterns."""
    low, near, out = F.lower(text), F.lit(False), text
    for hint in SECRET_HINTS:
        near = near | F.contains(low, F.lit(hint))
    for pattern, put in redaction_steps():
        out = F.regexp_replace(out, pattern, put)
    return F.when(near, out).otherwise(text)


def preview(text: Column, width: int = 200) -> Column:
    """One bounded, redacted line."""
    whole = collapse(redact(text))
    return F.when(F.length(whole) <= width, whole).otherwise(F.concat(F.substring(whole, 1, width - 1), F.lit("…")))


#: Evidence of failures, the first that matches decides.
FAILURES = (
    ("input_too_large", r"\binput_too_large\b|\binput exceeds the maximum length of \d+ characters"),
    ("authentication", r"(?:^|\n)\s*(?:401|403)(?:\b|:)|\bhttp(?:/\d(?:\.\d)?)?\s*(?:401|403)(?:\b|:)|\bunauthori[sz]ed\b|\bauthentication(?:[_ -]+(?:failed|required|error))\b"),
    ("quota", r"\b(?:quota\s+(?:exceeded|exhausted)|insufficient_quota)\b"),
    ("rate_limit", r"(?:^|\b)(?:http(?:/\d(?:\.\d)?)?\s*)?429(?:\b|:)|\brate[_ -]limit(?:ed|ing|[_ -]exceeded)?\b"),
    ("invalid_request", r"\binvalid[_ -]request\b"),
)
#: Fixed value: how a wait is named.
RETRY_AFTER = r"(?i)retry[- ]after\s*[:=]?\s*(\d+(?:\.\d+)?)"


def failure_category(evidence: Column) -> Column:
    out = F.lit("transport")
    for name, pattern in reversed(FAILURES):
        out = F.when(F.rlike(F.lower(evidence), F.lit(pattern)), F.lit("invalid_request" if name == "input_too_large" else name)).otherwise(out)
    return out


def retryable(category: Column) -> Column:
    return category.isin("rate_limit", "transport")


def retry_after(evidence: Column) -> Column:
    """Seconds to wait, between 1 and 3600; null if the evidence names none."""
    found = F.nullif(F.regexp_extract(evidence, RETRY_AFTER, 1), F.lit(""))
    return clamp(found.cast("double"), 1.0, 3600.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def is_identifier(x: Column) -> Column:
    return F.rlike(x, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"))


def is_digest(x: Column) -> Column:
    return F.rlike(x, F.lit(r"^[0-9a-f]{64}\z"))


def semantic_id(kind: str, *parts: Column, length: int = 20) -> Column:
    """``kind-`` and the head of the SHA-256 of the parts, which a NUL separates."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256), 1, length))


def literal(surface: str) -> str:
    """A surface as a pattern without metacharacters."""
    return "".join(c if c.isalnum() or c in " _" else f"\\{c}" for c in surface)


def term_pattern(surfaces: Sequence[str]) -> str:
    """Longest-first alternation of surfaces; guarded where a surface begins or ends with a word character."""
    kinds = sorted({s for s in surfaces if s}, key=lambda s: (-len(s), s.casefold(), s))
    guard = lambda s, at, mark: mark if s[at].isalnum() or s[at] == "_" else ""
    return "(?iU)" + "|".join(f"{guard(s, 0, r'(?<!\w)')}{literal(s)}{guard(s, -1, r'(?!\w)')}" for s in kinds)


def term_count(text: Column, surfaces: Sequence[str]) -> Column:
    """Occurrences of any surface that don't overlap."""
    return F.regexp_count(text, F.lit(term_pattern(surfaces)))


def flexible(needle: str) -> str:
    """A pattern for the words of a needle, ignoring case, with any white space between them."""
    return r"\s+".join(literal(w) for w in needle.split())


def overlapping_count(text: Column, needle: str) -> Column:
    """Occurrences of a needle, ignoring case; the next search starts one character after the last start."""
    return F.regexp_count(text, F.lit(f"(?iU)(?={flexible(needle)})"))


#: Ports and suffixes.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "pdf": "application/pdf", "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript"}
FORMATS = {"html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "tex": "tex", "pdf": "pdf"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))


def _lookup(key: Column, of: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), key)


def source_format(path: Column) -> Column:
    """Format by suffix, or 'unsupported_source'."""
    return F.coalesce(_lookup(suffix(path), FORMATS), F.lit("unsupported_source"))


def media_type(path: Column) -> Column:
    return F.coalesce(_lookup(suffix(path), MEDIA_TYPES), F.lit("application/octet-stream"))


def url_error(url: Column, origins: Sequence[str] = ()) -> Column:
    """Why an address isn't admitted, or null: https only, no credentials, port or fragment; host among the origins if any are given."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))
    out = F.when(~F.rlike(url, F.lit(r"^(?i:https)://")), "scheme_not_https")
    out = out.when(F.rlike(url, F.lit(r"^[^/]*//[^/?#]*@")), "credentials").when(F.rlike(url, F.lit(r"^[^/]*//[^/?#]*:\d+")), "port")
    out = out.when(F.contains(url, F.lit("#")), "fragment").when(host == "", "host_missing")
    return out.when(~host.isin(*origins), "origin_not_allowed") if origins else out


def https_url(url: Column) -> Column:
    """The address with scheme and host in lower case and a path; null if it isn't admitted."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+(.*)$", 1)
    return F.when(url_error(url).isNull(), F.concat(F.lit("https://"), host, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def markdown_plain(text: Column) -> Column:
    """Inline Markdown without its marks."""
    for pattern, put in ((r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`([^`]*)`", "$1"), (r"(\*\*|__)(.+?)\1", "$2"), (r"(\*|_)(.+?)\1", "$2"), (r"<[^>]+>", "")):
        text = F.regexp_replace(text, pattern, put)
    return collapse(text)


def tex_plain(text: Column) -> Column:
    """Inline TeX without comments, commands and braces."""
    for pattern, put in ((r"(?<!\\)%.*", ""), (r"\\(?:label|cite|ref)\{[^}]*\}", ""), (r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " "), (r"[{}$~]", " ")):
        text = F.regexp_replace(text, pattern, put)
    return collapse(text)
