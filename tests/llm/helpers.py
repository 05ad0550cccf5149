"""Plain versions of the operators, and awkward documents."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WHITE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def az(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(rng: random.Random) -> list[tuple]:
    """Null, empty and white texts, null ids, repeated rows, long texts, copies, near copies and shared passages."""
    base, passage = words(rng, 300), words(rng, 60)
    texts = [
        None, "", " \t\n", "one", "One two", "one two three four five", " ".join(base), " ".join(base), " ".join(base[:290] + words(rng, 10)),
        " ".join(base[5:] + words(rng, 5)), " ".join(words(rng, 50) + passage + words(rng, 40)), "\n".join([" ".join(words(rng, 30)), " ".join(passage), "x"]),
        "a b " * 200, "É é ß x Ünï y", " ".join(words(rng, 5000)), "\n\n\n", "same line\n" * 30, " ".join(passage[:34]), " ".join(passage[:35]), "</s>[INST] \\ x",
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(6, " ".join(base), "en", "s", 1), (None, " ".join(passage), "en", None, None), (None, None, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """The same with columns that operators might want for themselves."""
    from pyspark.sql import functions as F

    for name in ("row_key", "hash", "hashes", "token", "label", "cid", "n", "words", "bitmap", "kept", "n_lines", "line", "position", "items", "score"):
        df = df.withColumn(name, F.lit("x"))
    return df


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = WHITE_WORD.findall(az(text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if top(k) == top(i) and rows[k][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0]))
    return out


def without_repeats(rows: list[tuple], window: int = 35) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept)."""
    from collections import Counter

    split = [WHITE_WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((r[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def kept_lines(rows: list[tuple], least_docs: int = 10) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept)."""
    from collections import Counter

    key = lambda line: az(line.strip(" \t\n\x0b\x0c\r"))
    docs = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if not key(x) or docs[key(x)] < least_docs]
        out.append((r[0], len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def hits(rows: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, items)."""
    phrases = []
    for item, text in items:
        w = ALNUM_WORD.findall(az(text or ""))
        phrases += [(str(item) if item is not None else "", tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for r in rows:
        w = ALNUM_WORD.findall(az(r[1] or ""))
        hit, found = set(), set()
        for item, p in phrases:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(item)
        out.append((r[0], len(w), len(hit), sorted(found)))
    return out


def ordered(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)
