"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, replaces letters of other scripts that look like Latin
ones, undoes digit and sign substitutions, and turns runs of punctuation and
white space into one space, in texts and phrases alike. A lexicon entry matches words that begin with it and weighs as much as the words
it marks are more frequent in toxic than in other labelled texts. Hits inside
an exception phrase don't count. The sum of weights, normalised by the length
of the text, goes through a small calibrated regression to a score.

Entries, exceptions and regression are learned from a bounded sample of
labelled rows; each part of the sample is scored with the entries learned from
the other parts, and the regression is fitted to those scores.

Defined results: null and empty texts have no hits and get the score of a text
without hits; repeated rows are scored each for itself; null ids are kept (and
hash as empty text); other columns are ignored; an empty table gives no rows.
Without labels of both kinds every score is the share of label 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table
from tessera.llm.text_model import bucket, sample, sigmoid

#: Bounds of the sample: rows of either label, and bytes of a text (longer ones are scored whole, but not learned from).
TOXIC_ROWS, OTHER_ROWS, TEXT_BYTES = 1000, 1500, 16_384
SHORTEST, LONGEST = 3, 10
FOLDS = 3

#: Letters that look like Latin ones (Cyrillic, then Greek), and substitutions.
LOOKALIKES = "аbсԁеfɡһіјkӏмnорԛгѕтυѵԝхуz"
LOOKALIKES_TO = "abcdefghijklmnopqrstuvwxyz"
MORE_LOOKALIKES = "ікоαβεικνορτυχ"
MORE_LOOKALIKES_TO = "ikoabeiknoptux"
SUBSTITUTES, SUBSTITUTES_TO = "0134578@$", "oieastbas"


def _table() -> dict[int, str]:
    t = {ord(a): b for a, b in zip(MORE_LOOKALIKES + LOOKALIKES, MORE_LOOKALIKES_TO + LOOKALIKES_TO, strict=True)}
    t |= {ord(a): b for a, b in zip(SUBSTITUTES, SUBSTITUTES_TO, strict=True)}
    full = {0xFF01 + k: chr(0x21 + k) for k in range(94)}  # full-width forms
    t |= {k: t.get(ord(v.lower()), v.lower()) for k, v in full.items()}
    for c in [*range(0x21), *range(0x21, 0x7F), *range(0x80, 0xC0), *range(0x2000, 0x2070), *range(0x3000, 0x3010), 0xFEFF]:
        if c not in t and not chr(c).isalnum():
            t[c] = " "
    for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):  # invisible ones join what they part
        t[c] = ""
    return t


_FOLD = _table()


def fold(text: str | None) -> str:
    """Folded text with one space before each word and at the end."""
    return f" {' '.join((text or '').lower().translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """Weights of word beginnings, exception phrases, and the regression from hits to a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    line: tuple[float, ...] = (0.0, 0.0, 0.0, -3.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "line": self.line, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                a.add_word(" " + w, (len(w) + 1, x))
            for p in map(fold, self.exceptions):
                a.add_word(p, (len(p), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Weight of each word (by its place) that an entry marks; of several entries the heaviest counts."""
        found: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        if not self.weights:
            return found
        for end, (length, weight) in self.automaton().iter(folded):
            start = end - length + 1
            if weight is None:
                safe.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        for a, b in safe:
            for s in [s for s in found if a <= s < b]:
                del found[s]
        return found

    def features(self, folded: str) -> tuple[float, float, float]:
        """Weight by length, the logarithm of the hits, and the heaviest hit."""
        found = self.hits(folded)
        if not found:
            return 0.0, 0.0, 0.0
        total = sum(found.values())
        return float(np.log1p(100 * total / (len(folded.split()) + 10))), float(np.log1p(len(found))), max(found.values()) / 10

    def score(self, folded: str) -> float:
        return float(sigmoid(np.dot(self.line[:3], self.features(folded)) + self.line[3]))


def learn_entries(folded: list[str], y: np.ndarray) -> tuple[dict[str, float], tuple[str, ...]]:
    """Word beginnings that are much more frequent in toxic texts, and phrases that void them.

    Each text counts a beginning at most three times. An entry must occur in
    three toxic texts at least (two in small samples) and be well beyond chance.
    """
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    spread: Counter = Counter()
    words = [0, 0]
    for text, label in zip(folded, y.astype(int), strict=True):
        own: Counter = Counter()
        ws = text.split()
        words[label] += len(ws)
        for w in ws:
            own.update({w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1)})
        counts[label].update({w: min(c, 3) for w, c in own.items()})
        if label:
            spread.update(own.keys())
    fewest = 3 if y.sum() > 60 else 2
    share = words[1] / max(sum(words), 1)
    weights = {}
    for w, n in spread.items():
        a, b = counts[1][w], counts[0][w]
        expected = (a + b) * share
        ratio = (a + 0.1) / (b + 0.5) * (1 - share) / max(share, 1e-9)
        if n >= fewest and ratio > 6 and a - expected > 3.5 * np.sqrt(expected * (1 - share) + 0.3):
            weights[w] = float(np.log(ratio))
    longer: dict[str, int] = {}
    for w in weights:
        longer[w[:-1]] = max(longer.get(w[:-1], 0), counts[1][w])
    for w in [w for w in weights if longer.get(w, 0) >= 0.95 * counts[1][w]]:  # nearly always goes on alike: the longer one is meant
        del weights[w]
    for w in sorted(weights, key=len, reverse=True):  # a longer entry that says no more than a shorter one goes
        if any(weights.get(w[:k], 0) >= weights[w] - 0.1 for k in range(SHORTEST, len(w))):
            del weights[w]
    lexicon, phrases = Lexicon(weights), (Counter(), Counter())
    for text, label in zip(folded, y.astype(int), strict=True):
        for s in lexicon.hits(text):
            after = text[s : s + 80].split()[:2]
            if len(after) == 2:
                phrases[label][" ".join(after)] += 1
    return weights, tuple(sorted(p for p, n in phrases[0].items() if n >= 3 and not phrases[1][p]))


def train(texts: list[str], y: np.ndarray, share: float | None = None) -> Lexicon:
    """Entries from the whole sample; the regression from each fold scored by the others. share: of label 1 in all labelled rows."""
    share = float(y.mean()) if share is None and len(y) else share or 0.0
    if not len(y) or y.min() == y.max():
        return Lexicon({}, (), (0.0, 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))))
    folded = [fold(t) for t in texts]
    part = np.arange(len(y)) % FOLDS
    x = np.zeros((len(y), 4))
    x[:, 3] = 1
    for k in range(FOLDS):
        lexicon = Lexicon(*learn_entries([f for f, p in zip(folded, part, strict=True) if p != k], y[part != k]))
        for i in np.flatnonzero(part == k):
            x[i, :3] = lexicon.features(folded[i])
    own = y.mean()
    weight = np.where(y > 0, share / own, (1 - share) / (1 - own))
    w = np.zeros(4)
    for _ in range(50):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + 0.02 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(4)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return Lexicon(*learn_entries(folded, y), tuple(float(v) for v in w))


def fit(docs: DataFrame, labels: DataFrame, learn_from=None) -> Lexicon:
    """Train on a bounded sample of each label's rows."""
    ok = F.lit(True) if learn_from is None else learn_from
    toxic = sample(docs, labels, "toxic", ok & (F.col("toxic") == 1), TOXIC_ROWS, TEXT_BYTES)
    other = sample(docs, labels, "toxic", ok & (F.col("toxic") == 0), OTHER_ROWS, TEXT_BYTES)
    n = labels.where(ok).agg(F.avg("toxic")).first()[0]
    texts, y = toxic[0] + other[0], np.r_[toxic[1], other[1]]
    order = np.random.default_rng(7).permutation(len(y))
    return train([texts[i] for i in order], y[order], None if n is None else float(n))


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        lex = shared.value
        for batch in batches:
            folded = [fold(t) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "score": [lex.score(f) for f in folded]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def flagged_words(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and words (those that an entry marks, folded, in order) of the rows that have any."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, words = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                folded = fold(text)
                if found := shared.value.hits(folded):
                    ids.append(doc_id)
                    words.append([folded[s + 1 : folded.index(" ", s + 1)] for s in sorted(found)])
            yield {"doc_id": ids, "words": words}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, words array<string>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with a lexicon learned from the rows whose crc32 remainder by 5 isn't 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity(docs, fit(docs, labels, bucket(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
