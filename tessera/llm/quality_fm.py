"""Quality classifier: a factorisation machine.

Inputs are hashed words, statistics of the text's structure, and its length as
metadata. Each input has a weight and a low-rank vector; all pairs interact
through the products of their vectors, and the sum over pairs is taken in
linear time as half of (square of the sum minus sum of the squares), per rank.

Trained on a bounded sample of labelled rows and calibrated on a part of it
kept back. Defined results: null and empty texts are scored from their (zero)
statistics; repeated rows are scored each for itself; null ids are kept (and
hash as empty text); other columns are ignored; an empty table gives no rows.
Without labels of both kinds every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hash_words, map_arrow, raw, table
from tessera.llm.quality_rules import base_counts
from tessera.llm.text_model import Rows, bucket, calibrated, sample, sigmoid

#: log2 of the hashed word inputs, and the rank of the interactions.
BITS, RANK = 14, 8
WORDS = 1 << BITS
_SHIFT = np.uint64(64 - BITS)

_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _k = chr(_c)
    _CLASS[_c] = 0 if _c >= 0x80 else 1 if _k.isupper() else 2 if _k.islower() else 3 if _k.isdigit() else 4 if _k == "\n" else 5 if _k.isspace() else 6
STATISTICS = (
    "non_ascii", "upper", "lower", "digits", "punctuation", "symbols", "word_length", "distinct_words", "line_length",
    "repeated_lines", "repeated_windows", "repeated_neighbours", "capitalised", "sentence_ends",
)
#: Metadata: the length of the text in words, in steps of a factor of two.
LENGTHS = 20
SIZE = WORDS + 2 * len(STATISTICS) + LENGTHS


def statistics(data: bytes, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Each between 0 and about 1."""
    n, size = max(len(words), 1), max(len(data), 1)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7)
    chars, symbols, dup_lines, repeated = base_counts(data, words, hashes)
    lines = data.count(b"\n") + 1
    return np.array([
        kinds[0] / size, kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[6] / size, symbols / size,
        min(chars / n / 20, 2), len(set(words)) / n, min(np.log1p(n / lines) / 6, 2),
        dup_lines / lines, repeated / n, np.count_nonzero(hashes[1:] == hashes[:-1]) / n,
        sum(w[:1].isupper() for w in words) / n, (data.count(b".") + data.count(b"!") + data.count(b"?")) / n,
    ])


def inputs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's inputs; the words share a norm of one."""
    data = raw(text)
    words = data.split()
    hashes = hash_words(words)
    i, c = np.unique(hashes >> _SHIFT, return_counts=True)
    v = np.log1p(c)
    v = v / max(np.sqrt((v**2).sum()), 1e-9)
    s = statistics(data, words, hashes)
    k = np.arange(len(s))
    length = min(int(np.log2(len(words) + 1)), LENGTHS - 1)
    index = np.concatenate([i.astype(np.int64), WORDS + k, WORDS + len(s) + k, [SIZE - LENGTHS + length]])
    return index.astype(np.int32), np.concatenate([v, s, np.sqrt(s), [1.0]]).astype(np.float32)


@dataclass
class Machine:
    """Bias, weights, vectors, and the calibrated line through the raw score."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.vectors[index] * value[:, None]
        pairs = (v.sum(0) ** 2 - (v**2).sum(0)).sum() / 2
        return float(self.bias + value @ self.weights[index] + pairs)

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.a * self.raw(*inputs(text)) + self.b))


def train(texts: list[str], y: np.ndarray, epochs: int = 120, rate: float = 0.1, decay: float = 1e-5, seed: int = 11) -> Machine:
    """Full-batch Adagrad on three quarters of the sample; the last quarter calibrates."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Machine(float(np.log(p / (1 - p))), np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32))
    parts = [inputs(t) for t in texts]
    held = np.arange(len(y)) % 4 == 3
    rows = Rows([p for p, h in zip(parts, held, strict=True) if not h])
    target, squares = y[~held], Rows([])
    squares.sizes, squares.index, squares.row, squares.value = rows.sizes, rows.index, rows.row, rows.value**2
    share = target.mean()
    balance = np.where(target > 0, 0.5 / share, 0.5 / (1 - share)) / len(target)
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)), 0.0
    past_w, past_v, past_b = np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-8), 1e-8
    for _ in range(epochs):
        sums = rows.dot(v)
        z = bias + rows.dot(w) + 0.5 * (sums**2 - squares.dot(v**2)).sum(1)
        g = (sigmoid(z) - target) * balance
        gw = rows.back(g, SIZE) + decay * w
        whole = squares.back(g, SIZE)
        for r in range(RANK):
            gv = rows.back(g * sums[:, r], SIZE) - v[:, r] * whole + decay * v[:, r]
            past_v[:, r] += gv**2
            v[:, r] -= rate * gv / np.sqrt(past_v[:, r])
        past_w += gw**2
        w -= rate * gw / np.sqrt(past_w)
        past_b += g.sum() ** 2
        bias -= rate * g.sum() / np.sqrt(past_b)
    machine = Machine(bias, w.astype(np.float32), v.astype(np.float32))
    scores = np.array([machine.raw(*p) for p, h in zip(parts, held, strict=True) if h])
    machine.a, machine.b = calibrated(scores, y[held])
    return machine


def fit(docs: DataFrame, labels: DataFrame, learn_from=None) -> Machine:
    return train(*sample(docs, labels, "quality", F.lit(True) if learn_from is None else learn_from))


def classify(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "score": [shared.value.score(t) for t in batch.column("text").to_pylist()]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with a machine trained on the rows whose crc32 remainder by 3 isn't 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = classify(docs, fit(docs, labels, bucket(F.col("doc_id"), 3) != 1))
    return scored.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
