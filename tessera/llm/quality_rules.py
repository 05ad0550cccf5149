"""Quality rules: fixed rules, and a calibrated n-gram classifier behind a fixed threshold.

The base rules look at words, symbols, repeated lines and repeated five-word
windows. The classifier is a logistic regression on hashed word one- and
two-grams and character (code point) three- and four-grams, each group averaged
over the whole text; a word after itself is one two-gram whatever the word, so
that repetition is learned from few rows. It is trained on a bounded sample of
labelled rows, calibrated on a part of that sample kept back, and applied in
Arrow batches against fixed thresholds.

Defined results: null and empty texts have no words, fail the base rules and
aren't kept; repeated rows are judged each for itself; null ids are kept; other
columns are ignored; an empty table gives no rows. Without labels of both kinds
the classifier keeps everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, chain, hash_words, map_arrow, raw, table, window_hashes
from tessera.llm.text_model import Rows, calibrated, sample, sigmoid

#: Documents are kept if their calibrated probability is at least this.
THRESHOLD = 0.5
#: The grade is how many of these the probability reaches.
GRADES = (0.1, 0.5, 0.9)
FEWEST_WORDS = 10
#: Most percent of the words in repeated windows.
MOST_REPEATED = 20
REPEAT_WINDOW = 5
#: log2 of the hashed features of each of the four groups.
BITS = 15
GROUPS = 4

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(data: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    b = np.frombuffer(data, np.uint8)
    chars = int(np.count_nonzero(((b & 0xC0) != 0x80) & ~_WHITE[b]))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    w = window_hashes(hashes, REPEAT_WINDOW)
    repeated = 0
    if len(w) > 1:
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        if same.any():
            flags = np.zeros(len(w), np.int32)
            flags[order[1:][same]] = 1
            flags[order[:-1][same]] = 1
            edge = np.zeros(len(words) + 1, np.int32)
            edge[: len(w)] += flags
            edge[REPEAT_WINDOW : REPEAT_WINDOW + len(w)] -= flags
            repeated = int(np.count_nonzero(np.cumsum(edge[: len(words)])))
    return chars, int(np.count_nonzero(_SYMBOL[b])), len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < FEWEST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words


_SHIFT = np.uint64(64 - BITS)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(1)


def code_points(data: bytes) -> np.ndarray:
    if data.isascii():
        return np.frombuffer(data, np.uint8).astype(np.uint64)
    return np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def feature_groups(data: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashed word one- and two-grams and character three- and four-grams, as numbers below 2 ** BITS."""
    c = code_points(data)
    three = four = np.zeros(0, np.uint64)
    if len(c) >= 3:  # a code point has 21 bits
        code = c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)
        three = code * _STEP >> _SHIFT
        if len(c) >= 4:
            four = (code[:-1] * _STEP ^ c[3:]) * _STEP >> _SHIFT
    two = chain(hashes[:-1], hashes[1:])
    two[hashes[:-1] == hashes[1:]] = _SAME << _SHIFT
    return [hashes >> _SHIFT, two >> _SHIFT, three, four]


@dataclass
class Classifier:
    """Weights of each group's hashed features, and the calibrated line through their sum."""

    weights: np.ndarray
    a: float = 0.0
    b: float = 35.0

    def score(self, data: bytes, hashes: np.ndarray) -> float:
        z = 0.0
        for w, f in zip(self.weights, feature_groups(data, hashes), strict=True):
            if len(f):
                z += float(w[f].mean())
        return float(sigmoid(self.a * z + self.b))


def _rows(texts: list[str]) -> Rows:
    parts = []
    for t in texts:
        data = raw(t)
        index, value = [], []
        for k, f in enumerate(feature_groups(data, hash_words(data.split()))):
            i, c = np.unique(f, return_counts=True)
            index.append((i.astype(np.int64) + (k << BITS)).astype(np.int32))
            value.append(c / max(len(f), 1))
        parts.append((np.concatenate(index), np.concatenate(value)))
    return Rows(parts)


def train(texts: list[str], y: np.ndarray, epochs: int = 150, rate: float = 0.5, decay: float = 1e-6) -> Classifier:
    """Full-batch Adagrad on three quarters of the sample; the last quarter calibrates."""
    size = GROUPS << BITS
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros((GROUPS, 1 << BITS), np.float32))
    held = np.arange(len(y)) % 4 == 3
    fit = _rows([t for t, h in zip(texts, held, strict=True) if not h])
    target = y[~held]
    balance = np.where(target > 0, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6)) / len(target)
    w, past, bias, past_b = np.zeros(size), np.full(size, 1e-12), 0.0, 1e-12
    for _ in range(epochs):
        g = (sigmoid(fit.dot(w) + bias) - target) * balance
        gw = fit.back(g, size) + decay * w
        past += gw**2
        w -= rate * gw / np.sqrt(past)
        past_b += g.sum() ** 2
        bias -= rate * g.sum() / np.sqrt(past_b)
    weights = w.astype(np.float32)
    back = _rows([t for t, h in zip(texts, held, strict=True) if h])
    a, b = calibrated(back.dot(weights), y[held])
    return Classifier(weights.reshape(GROUPS, -1), a, b)


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    return train(*sample(docs, labels, "quality", F.lit(True)))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double, grade int"


def judge(model: Classifier, text: str | None, threshold: float = THRESHOLD) -> tuple:
    data = raw(text)
    words = data.split()
    hashes = hash_words(words)
    counts = base_counts(data, words, hashes)
    failed = base_failed(len(words), counts[3])
    p = model.score(data, hashes)
    return len(words), *counts, failed, not failed and p >= threshold, p, sum(p >= g for g in GRADES)


def quality(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The counts, verdicts and probability of every row; see SCHEMA."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [judge(shared.value, t, threshold) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), **{n: [f[k] for f in found] for k, n in enumerate(names)}}

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def keep_good(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that quality rules keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [judge(shared.value, t, threshold)[6] for t in batch.column(where).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    arrow_limits(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with a classifier trained on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


#: The base columns in SQL; the verdict needs the classifier.
BASE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + {REPEAT_WINDOW} - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {REPEAT_WINDOW} + 2)) AS i FROM d WHERE len(w) >= {REPEAT_WINDOW})),
often AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + {REPEAT_WINDOW})) AS k FROM windows SEMI JOIN often USING (doc_id, g))
  GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c
"""
