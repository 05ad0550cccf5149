"""Substring dedup by level-wise doubling.

A passage of ``window`` words that occurs twice holds, at the same offset in
both places, the same shorter window of lowest hash. So each passage is judged
at a short length through that one window: only if it is repeated anywhere is
the passage extended and judged again at twice the length, and so on until the
full length is reached or no candidate survives. Each level counts hashes with
map-side aggregation; a hash that occurs once brings its document along and is
taken from that document's candidates. So a passage in a third of all documents
is one row a task, neither gathered in one task nor paired with itself.

``repeat_lengths`` has no full length: it doubles until no window survives.

Defined results: null and empty texts have no words and lose none; texts of
fewer words than the window lose none; a repeated row is a document of its own
and so repeats its windows; null ids are kept; other columns are ignored; an
empty table gives no rows. Full windows are told apart by 128-bit hashes of
their word sequence, shorter ones by 64 bits, as a clash there only lets a
candidate through to the next level. Rows are told apart by 128 bits.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm.common import hash_words, map_arrow, row_keys, rows_of, sha256, table, white_words, window_hashes

WINDOW = 35
#: No level is shorter than this many words: shorter windows recur by chance.
SHORTEST = 8


def level_lengths(window: int, shortest: int = SHORTEST) -> list[int]:
    """Ascending lengths, each at most twice the one before, that end in ``window``."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= shortest:
        out.insert(0, half)
    return out


def lowest(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring entries."""
    n, span, cur = len(hashes) - width + 1, 1, hashes
    while span * 2 <= width:
        cur, span = np.minimum(cur[:-span], cur[span:]), span * 2
    return np.minimum(cur[:n], cur[width - span : width - span + n])


def stand_ins(first: np.ndarray, window: int, length: int) -> np.ndarray:
    """For each passage of ``window`` words, the hash of the lowest window of ``length`` words inside."""
    return lowest(first, window - length + 1)


def judged(words: list[bytes], window: int, shorter: int | None, length: int, known: list[int]) -> np.ndarray | None:
    """The stand-ins of ``length`` words of the passages that are alive, each once, or twice if it stands at several places of the text.

    A passage is alive if its stand-in of ``shorter`` words is known to be repeated; at the first level all are.
    """
    if len(words) < window:
        return None
    h = hash_words(words)
    k = window_hashes(h, length)
    low = stand_ins(k, window, length)
    if shorter is not None:
        low = low[_alive(h, window, shorter, known)]
    v = np.unique(low)
    if not len(v):
        return None
    at = np.minimum(np.searchsorted(v, k), len(v) - 1)
    times = np.bincount(at[v[at] == k], minlength=len(v))
    return np.repeat(v, np.minimum(times, 2)).view(np.int64)


def _alive(h: np.ndarray, window: int, shorter: int, known: list[int]) -> np.ndarray:
    a = np.sort(np.asarray(known, np.int64).view(np.uint64))
    low = stand_ins(window_hashes(h, shorter), window, shorter)
    return a[np.minimum(np.searchsorted(a, low), len(a) - 1)] == low


def whole_windows(words: list[bytes], length: int, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Both halves of the hashes of the windows of ``length`` words, and their places; of those that are chosen by a flag, or of all."""
    if len(words) < length:
        return None
    places = np.arange(len(words) - length + 1, dtype=np.int32) if chosen is None else np.flatnonzero(chosen).astype(np.int32)
    if not len(places):
        return None
    a, b = (window_hashes(hash_words(words, second), length)[places].view(np.int64) for second in (False, True))
    return a, b, places


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", *row_keys("k1", "k2"))


def _emit(source: DataFrame, state: str | None, columns: str, find: Callable) -> DataFrame:
    """The columns that ``find`` gives of each text's words and state; texts of which it gives none are left out."""
    names, out_names = ["k1", "k2", "text"] + ([state] if state else []), [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("k1", "k2", *out_names)}
            for k1, k2, text, *known in rows_of(batch, *names):
                found = find(white_words(text), *known)
                if found is not None:
                    for c, v in zip(out, (k1, k2, *found), strict=True):
                        out[c].append(v)
            yield out

    # the number of a row is fixed once the table is written
    return map_arrow(source.select(*names), run, f"k1 long, k2 long, {columns}").withColumn("row", F.monotonically_increasing_id())


#: Places in a word of a bitmap.
BITS = 63


def _repeated(emitted: DataFrame, on: list[str], value: str) -> DataFrame:
    """(k1, k2, state): of each text, the values of the entries whose hash ``on`` occurs twice or more in all texts.

    ``emitted``, a written table, has an array of each of the columns. Hashes come as a set, places as the words of a
    bitmap. A hash that occurs once brings its row and value along in the count, so that nothing is joined with the
    hashes: each text loses what it alone has, and what all texts share is merged before it moves.
    """
    names = list(dict.fromkeys([*on, value]))
    flat = emitted.select("row", F.explode(F.arrays_zip(*names)).alias("x")).select("row", *(f"x.{n}" for n in names))
    only = [F.min("row").alias("row"), *([] if value in on else [F.min(value).alias(value)])]
    alone = flat.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), *only).where("n = 1").select("row", value)
    lost = scratch.materialize(alone.groupBy("row").agg(F.collect_list(value).alias("lost")), "alone")
    both = emitted.select("row", "k1", "k2", F.col(value).alias("all")).join(lost, "row", "left")
    left = both.select("k1", "k2", F.array_except("all", F.coalesce("lost", F.array())).alias("state")).where(F.size("state") > 0)
    if value not in on:
        left = map_arrow(left, _bitmaps, "k1 long, k2 long, state array<struct<word: int, bits: long>>")
    # rows alike in id and text have the same state
    return left.groupBy("k1", "k2").agg(F.first("state").alias("state"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {"k1": [], "k2": [], "state": []}
        for k1, k2, places in rows_of(batch, "k1", "k2", "state"):
            at = np.asarray(places, np.int64)
            word, of = np.unique(at // BITS, return_inverse=True)
            bits = np.zeros(len(word), np.int64)
            np.bitwise_or.at(bits, of, np.int64(1) << (at % BITS))
            out["k1"].append(k1)
            out["k2"].append(k2)
            out["state"].append([{"word": w, "bits": v} for w, v in zip(word.tolist(), bits.tolist(), strict=True)])
        yield out


def places_of(state: list[dict]) -> np.ndarray:
    """The places in a bitmap, ascending."""
    word = np.array([w["word"] for w in state], np.int64)
    bits = np.array([w["bits"] for w in state], np.int64)
    flags = (bits[:, None] >> np.arange(BITS)) & 1
    return np.sort((word[:, None] * BITS + np.arange(BITS))[flags > 0])


_WHOLE = "a array<long>, b array<long>, places array<int>"


def repeated_windows(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """(k1, k2, state): of each text that has any, the places of its windows that occur twice or more, as a bitmap's words.

    (k1, k2) is the 128-bit key of (doc_id, text).
    """
    rows = _keyed(docs)
    *levels, _ = level_lengths(window, shortest)
    with scratch.owner() as made:
        state, shorter = None, None
        for length in levels:
            source = rows if state is None else rows.join(state, ["k1", "k2"])
            find = lambda words, known=None, shorter=shorter, length=length: None if (v := judged(words, window, shorter, length, known)) is None else (v,)
            emitted = scratch.materialize(_emit(source, None if state is None else "state", "hashes array<long>", find), "windows")
            made.keep(emitted)
            state, shorter = scratch.materialize(_repeated(emitted, ["hashes"], "hashes"), "repeated"), length
            made.keep(state)
        source = rows if state is None else rows.join(state, ["k1", "k2"])
        choose = lambda words, known: _alive(hash_words(words), window, shorter, known) if len(words) >= window else None
        find = lambda words, known=None: whole_windows(words, window, None if known is None else choose(words, known))
        emitted = scratch.materialize(_emit(source, None if state is None else "state", _WHOLE, find), "windows")
        made.keep(emitted)
        state = scratch.materialize(_repeated(emitted, ["a", "b"], "places"), "repeated")
        made.keep(state)
    return state


def repeat_lengths(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id and length: the greatest of shortest, 2 * shortest, 4 * shortest, … words of which the row has a repeated window.

    A window of twice the length is a candidate if both its halves are repeated; the levels end when none is left.
    Rows without a repeated window of ``shortest`` words are left out.
    """
    rows, reached, length, state = _keyed(docs), [], shortest, None

    def find(words: list[bytes], known: list[dict] | None = None, length: int = shortest) -> tuple | None:
        if known is None:
            return whole_windows(words, length, None)
        if len(words) < length:
            return None
        flags = np.zeros(len(words), bool)
        flags[places_of(known)] = True
        half, n = length // 2, len(words) - length + 1
        return whole_windows(words, length, flags[:n] & flags[half : half + n])

    with scratch.owner() as made:
        while True:
            source = rows if state is None else rows.join(state, ["k1", "k2"])
            emitted = scratch.materialize(_emit(source, None if state is None else "state", _WHOLE, functools.partial(find, length=length)), "windows")
            state = scratch.materialize(_repeated(emitted, ["a", "b"], "places"), "repeated")
            if state.isEmpty():
                break
            reached.append(scratch.materialize(state.select("k1", "k2", F.lit(length).alias("length")), "reached"))
            made.keep(state, *reached)
            length *= 2
        made.keep(*reached)
    if not reached:
        return rows.select("doc_id", F.lit(0).alias("length")).limit(0)
    longest = reached[0]
    for r in reached[1:]:
        longest = longest.unionByName(r)
    return rows.join(longest.groupBy("k1", "k2").agg(F.max("length").alias("length")), ["k1", "k2"]).select("doc_id", "length")


def covered_words(n_words: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the (distinct) places."""
    edge = np.zeros(n_words + 1, np.int32)
    edge[places] += 1
    edge[places + window] -= 1
    return np.cumsum(edge[:n_words]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, digests: bool = False) -> DataFrame:
    """Each row of ``docs`` without the words that a repeated window covers.

    Rows: doc_id, n_words, n_removed and kept (words joined by one space), or its digest kept_sha256.
    """
    repeated = repeated_windows(docs, window, shortest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, counts, removed, kept = [], [], [], []
            for doc_id, text, state in rows_of(batch, "doc_id", "text", "state"):
                words = white_words(text)
                n = len(words)
                if state:
                    gone = covered_words(n, places_of(state), window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                left = b" ".join(words)
                ids.append(doc_id)
                counts.append(n)
                removed.append(n - len(words))
                kept.append(sha256(left) if digests else left.decode("utf-8", "surrogatepass"))
            yield {"doc_id": ids, "n_words": counts, "n_removed": removed, "kept": kept}

    joined = _keyed(docs).join(repeated, ["k1", "k2"], "left").select("doc_id", "text", "state")
    out = map_arrow(joined, cut, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256") if digests else out


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 35 words, judged at 9, 18 and 35."""
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW} - 1], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM windows SEMI JOIN often USING (h)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
