"""Labelled samples for the classifiers that are trained here, and how their scores become probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a training sample: rows, and UTF-8 bytes of a text. Longer texts are scored whole, but not learned from.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 32_768
SEED = 20240601


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids count as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels (0/1) of at most ``rows`` labelled documents that ``learn_from`` allows.

    The rows with the lowest hash of their id are taken, so the choice doesn't
    depend on how the tables are stored. First ids are chosen, then their texts
    are read; rows without a label or text are left out. Of several labels of an
    id the greatest counts, of several texts the least one.
    """
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn_from)
    ids = wanted.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)
    known = {r.doc_id: int(r.label) for r in ids.collect()}
    if not known:
        return [], np.zeros(0)
    chosen = docs.sparkSession.createDataFrame([(k,) for k in known], "doc_id long")
    texts = docs.where("text is not null").where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    found = sorted((r.doc_id, r.text) for r in texts.groupBy("doc_id").agg(F.min("text").alias("text")).collect())  # one an id
    return [t for _, t in found], np.array([known[i] for i, _ in found], float)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def calibrated(scores: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt's a, b so that sigmoid(a * score + b) is a probability; targets are smoothed, steps are Newton's."""
    if not len(y) or y.min() == y.max():
        return (1.0, 0.0)
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    mean, std = scores.mean(), scores.std() + 1e-9
    x = np.c_[(scores - mean) / std, np.ones(len(y))]
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - t) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    a = max(w[0], 0.0) / std
    return float(a), float(w[1] - a * mean)


class Rows:
    """Sparse rows (indices and values) laid end to end."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.sizes = np.array([len(i) for i, _ in parts], np.int64)
        self.index = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in parts]).astype(np.float32) if parts else np.zeros(0, np.float32)
        self.row = np.repeat(np.arange(len(parts)), self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Row sums of value * w[index]; also for a matrix w."""
        if w.ndim == 1:
            return np.bincount(self.row, self.value * w[self.index], len(self.sizes))
        return np.stack([self.dot(np.ascontiguousarray(c)) for c in w.T], axis=1)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        """For each index the sum of value * g[row]."""
        return np.bincount(self.index, self.value * g[self.row], size)
