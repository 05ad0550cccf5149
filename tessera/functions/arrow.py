"""Functions that built-in expressions don't have, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType  # a type, not a name: workers import this module without a session

from tessera.functions.text import redaction_steps


@pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding (ß becomes ss)."""
    return s.map(lambda x: None if x is None else " ".join(x.split()).casefold())


def normalize_term_text(value: str) -> str:
    """NFKC, white space collapsed, punctuation at the ends removed, case folded."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip(" \t\r\n,;:.").casefold()


@pandas_udf(StringType())
def normalize_term(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else normalize_term_text(x))


def canonical_json(value) -> str:
    """Sorted keys, compact, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@pandas_udf(StringType())
def json_digest(s: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of a JSON text; null if it isn't finite JSON."""

    def one(x):
        try:
            return hashlib.sha256(canonical_json(json.loads(x)).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return s.map(one)


@pandas_udf(StringType())
def reduced_ratio(w: pd.Series, h: pd.Series) -> pd.Series:
    """width:height in lowest terms; null unless both are positive."""

    def one(a, b):
        if pd.isna(a) or pd.isna(b) or a <= 0 or b <= 0:
            return None
        g = math.gcd(int(a), int(b))
        return f"{int(a) // g}:{int(b) // g}"

    return pd.Series([one(a, b) for a, b in zip(w, h, strict=True)])


_ENVIRONMENTS = r"equation|align|gather|multline|eqnarray|displaymath|math"


def normalize_tex_text(value: str) -> str:
    """TeX of a formula without comments, labels, tags, penalties, outer display environment and delimiters."""
    x = re.sub(r"(?<!\\)%[^\n]*", "", value)
    x = re.sub(r"\\(?:label|tag)\*?\{[^{}]*\}", "", x)
    x = re.sub(r"\\penalty\s*-?\d+", "", x)
    x = re.sub(r"\\color\{black\}", "", x)
    x = re.sub(r"(\\begin\{array\})\[\]", r"\1", x)
    x = " ".join(x.split())
    m = re.fullmatch(rf"\\begin\{{((?:{_ENVIRONMENTS})\*?)\}}(.*)\\end\{{\1\}}", x, re.DOTALL)
    if m:
        x = m[2].strip()
    for a, b in (("$$", "$$"), (r"\[", r"\]"), (r"\(", r"\)"), ("$", "$")):
        if len(x) >= len(a) + len(b) and x.startswith(a) and x.endswith(b):
            x = x[len(a) : len(x) - len(b)].strip()
            break
    return " ".join(x.split())


@pandas_udf(StringType())
def normalize_tex(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else normalize_tex_text(x))


#: Names of fields that hold secrets, in lower case and without other signs.
SECRET_FIELDS = frozenset("apikey authorization cookie credential password passwd refreshtoken secret setcookie token xapikey accesstoken".split())


def redacted(value):
    """A JSON value with secret fields and credentials in its texts replaced, at any depth."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if re.sub("[^a-z0-9]", "", k.lower()) in SECRET_FIELDS else redacted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v) for v in value]
    if isinstance(value, str):
        for pattern, put in redaction_steps("\\"):
            value = re.sub(pattern, put, value)
    return value


@pandas_udf(StringType())
def redact_json(s: pd.Series) -> pd.Series:
    """Canonical JSON of the redacted value; null if the text is no JSON."""

    def one(x):
        try:
            return canonical_json(redacted(json.loads(x)))
        except (TypeError, ValueError):
            return None

    return s.map(one)
