"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` writes the postings of every training token as a table of
segments, each holding a bounded number of tokens of whole documents. A search
visits each segment on its own. The phrases whose terms all have a list there
are reached by their terms; each takes the list of its term that is rarest in
the segment, shifts it by the term's offset, and intersects it with the shifted
lists of its other terms, rarest first. All phrases go through one rank of
rarity at a time, as arrays. Proximity matches start from the same rarest
lists. Segments don't grow with the input; only their number does, so neither a
frequent term nor a large source makes one task long.

A benchmark goes block by block: one block of bounded size is collected,
searched, its hits written and its broadcast destroyed before the next.

Defined results: null and empty texts have no words and are never hit; repeated
rows are indexed each for itself; an item without words has no phrase; a null
item id is written as an empty string; other columns are ignored; empty tables
give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm.common import LOWER, UPPER, alnum_words, fresh, map_arrow, row_keys, rows_of, table

WINDOW = 10
#: Words more than the phrase's that a proximity match may hold.
SLOP = 5
#: Tokens of a segment; a longer document is a segment of its own.
SEGMENT_TOKENS = 1_000_000
#: Bytes of benchmark text searched in one pass; larger benchmarks are searched in blocks of items.
BLOCK_BYTES = 16 << 20
#: Candidate places looked at in one step.
STEP = 1 << 20

#: The tables by the type of doc_id, which may also be a string.
_SEGMENT = "segment string, doc_ids array<{}>, n_words array<int>, terms binary, ends binary, gaps binary"
_HITS = "row string, doc_id {}, n_words long, n_hit long, items array<string>, near array<string>, hit_at array<int>"
_MATCHES = "doc_id {}, item_id string, item_offset int, position long, span int"
_LISTS = ("n_words", "terms", "ends", "gaps")


def _segment(ids: list, counts: list[int], words: list[bytes]) -> dict:
    """Postings of one segment: distinct terms, the end of each list, and the gaps between ascending positions.

    Positions run through the segment and leave one free after each document,
    so that no phrase reaches from one document into the next.
    """
    number: dict[bytes, int] = {}
    term = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    place = np.arange(len(words), dtype=np.int32) + np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    order = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=len(number)), dtype=np.int32)
    place = place[order]
    gaps = np.diff(place, prepend=np.int32(0)).astype(np.int32)
    if len(ends):
        gaps[np.r_[0, ends[:-1]]] = place[np.r_[0, ends[:-1]]]
    return {
        "segment": [uuid.uuid4().hex], "doc_ids": [ids], "n_words": [counts], "terms": [b"\n".join(number)],
        "ends": [ends.tobytes()], "gaps": [gaps.tobytes()],
    }


def build_index(docs: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Index every row of ``docs`` (doc_id, text); one result row is one segment."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, counts, words = [], [], []
        for batch in batches:
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                found = alnum_words(text)
                if ids and len(words) + len(found) > segment_tokens:
                    yield _segment(ids, counts, words)
                    ids, counts, words = [], [], []
                ids.append(doc_id)
                counts.append(len(found))
                words += found
        if ids:
            yield _segment(ids, counts, words)

    return map_arrow(docs.select("doc_id", "text"), build, _SEGMENT.format(docs.schema["doc_id"].dataType.simpleString()))


def _id_type(index: DataFrame) -> str:
    return index.schema["doc_ids"].dataType.elementType.simpleString()


class Block:
    """The phrases of a block of benchmark items, as numbers of the block's own terms."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = [i for i, _ in items]
        number: dict[bytes, int] = {}
        words = [alnum_words(t) for _, t in items]
        sizes = np.array([len(w) for w in words], np.int64)
        self.codes = np.array([number.setdefault(w, len(number)) for of in words for w in of], np.int64)
        self.terms = list(number)
        count = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
        #: Of each phrase: its item, its offset there, its first word among the codes, and its length.
        self.item = np.repeat(np.arange(len(items)), count)
        self.offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.start = np.repeat(np.cumsum(sizes) - sizes, count) + self.offset
        self.length = np.minimum(sizes, window)[self.item]


class Segment:
    """One segment opened for reading: posting lists one after another, each entry with its term's number above the position."""

    def __init__(self, counts: list[int], terms: bytes, ends: bytes, gaps: bytes):
        self.terms = terms.split(b"\n") if ends else []
        last = np.frombuffer(ends, np.int32).astype(np.int64)
        self.first = np.r_[0, last]
        self.counts = np.diff(self.first)
        total = np.cumsum(np.frombuffer(gaps, np.int32), dtype=np.int64)
        before = np.r_[0, total][self.first[:-1]]
        self.places = total - np.repeat(before, self.counts)
        self.keys = np.repeat(np.arange(len(self.counts)) << 32, self.counts) + self.places
        self.starts = np.cumsum([0, *(c + 1 for c in counts)])

    def meets(self, block: Block) -> list[np.ndarray]:
        """Of the block's phrases those whose terms all have a list here, by length: their numbers and terms, rarest first, and offsets."""
        here = {t: i for i, t in enumerate(self.terms)}
        number = np.array([here.get(t, -1) for t in block.terms], np.int64)
        codes = number[block.codes] if len(number) else block.codes
        missing = np.r_[0, np.cumsum(codes < 0)]
        whole = missing[block.start + block.length] == missing[block.start]
        out = []
        for n in np.unique(block.length[whole]).tolist():
            phrases = np.flatnonzero(whole & (block.length == n))
            of = codes[block.start[phrases][:, None] + np.arange(n)]
            rank = np.argsort(self.counts[of], axis=1, kind="stable")
            out.append((phrases, np.take_along_axis(of, rank, 1), rank))
        return out

    def postings(self, phrases: np.ndarray, of: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each phrase's number in the arrays with every place of its rarest term, a bounded number at a time."""
        n = self.counts[of[:, 0]]
        step = np.cumsum(n) // STEP
        for k in np.unique(step):
            rows = np.flatnonzero(step == k)
            many = n[rows]
            at = np.repeat(self.first[of[rows, 0]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield np.repeat(rows, many), self.places[at]

    def phrases(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and the places at which their words stand one after another."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for phrases, of, rank in self.meets(block):
            for row, place in self.postings(phrases, of, rank):
                at = place - rank[row, 0]
                for j in range(1, of.shape[1]):
                    row, at = row[at >= 0], at[at >= 0]
                    wanted = (of[row, j] << 32) + at + rank[row, j]
                    k = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                    same = self.keys[k] == wanted
                    row, at = row[same], at[same]
                found.append((phrases[row], at))
        return np.concatenate([p for p, _ in found]), np.concatenate([a for _, a in found])

    def near(self, block: Block, slop: int) -> set[tuple[int, int, int]]:
        """(phrase, place, span) of the tightest stretch around each place of a phrase's rarest term that holds all its
        words, in any order, within ``slop`` words more and within one document."""
        found = set()
        for phrases, of, rank in self.meets(block):
            reach = of.shape[1] + slop
            for row, place in self.postings(phrases, of, rank):
                for j in range(1, of.shape[1]):  # each other term somewhere in reach: few places stay
                    low, high = self._around(place, reach)
                    k = np.searchsorted(self.keys, (of[row, j] << 32) + low)
                    some = self.keys[np.minimum(k, len(self.keys) - 1)] < (of[row, j] << 32) + high
                    some &= k < len(self.keys)
                    row, place = row[some], place[some]
                low, high = self._around(place, reach)
                for r, p, a, b in zip(row.tolist(), place.tolist(), low.tolist(), high.tolist(), strict=True):
                    best = self._tightest(dict.fromkeys(of[r].tolist()), p, a, b, reach)
                    if best:
                        found.add((int(phrases[r]), best[1], best[0]))
        return found

    def _around(self, place: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        d = np.searchsorted(self.starts, place, "right")
        return np.maximum(place - reach + 1, self.starts[d - 1]), np.minimum(place + reach, self.starts[d])

    def _tightest(self, terms: dict[int, None], p: int, low: int, high: int, reach: int) -> tuple[int, int] | None:
        """(span, place) of the tightest stretch within the bounds that holds p and all terms (the first one is p's own)."""
        lists = []
        for t in list(terms)[1:]:
            a, b = np.searchsorted(self.keys, [(t << 32) + low, (t << 32) + high])
            lists.append(self.places[a:b])
        best = None
        for left in {p, *(int(x) for a in lists for x in a if x <= p)}:
            ends = [int(a[k]) if (k := np.searchsorted(a, left)) < len(a) else None for a in lists]
            if all(e is not None for e in ends):
                span = max([p, *ends]) - left + 1
                if span <= reach and (best is None or (span, left) < best):
                    best = (span, left)
        return best


def _blocks(items: DataFrame, block_bytes: int) -> tuple[int, Callable[[int], list[tuple[str, str | None]]]]:
    """The number of blocks, and a function that collects one of them."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, lambda k: [tuple(r) for r in (items if n == 1 else items.where(part == k)).collect()]


def _search(index: DataFrame, shared, places: bool, slop: int | None) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        block = shared.value

        def items_of(docs: np.ndarray, phrases: np.ndarray, n: int) -> list[list[str]]:
            out: list[set[str]] = [set() for _ in range(n)]
            for d, i in set(zip(docs.tolist(), block.item[phrases].tolist(), strict=True)):
                out[d].add(block.names[i])
            return [sorted(x) for x in out]

        for batch in batches:
            for name, ids, *lists in rows_of(batch, "segment", "doc_ids", *_LISTS):
                seg = Segment(*lists)
                phrase, at = seg.phrases(block)
                edge = np.zeros(seg.starts[-1] + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + block.length[phrase], -1)
                inside = np.cumsum(edge) > 0
                hit = np.r_[0, np.cumsum(inside)]
                near = np.array(sorted(seg.near(block, slop)) if slop is not None else [], np.int64).reshape(-1, 3)
                of = lambda x: np.searchsorted(seg.starts, x, "right") - 1
                yield {
                    "row": [f"{name}-{d}" for d in range(len(ids))],
                    "hit_at": [np.flatnonzero(inside[a:b]) if places and hit[a] != hit[b] else [] for a, b in zip(seg.starts[:-1], seg.starts[1:], strict=True)],
                    "doc_id": ids, "n_words": lists[0], "n_hit": hit[seg.starts[1:]] - hit[seg.starts[:-1]],
                    "items": items_of(of(at), phrase, len(ids)), "near": items_of(of(near[:, 1]), near[:, 0], len(ids)),
                }

    return map_arrow(index, search, _HITS.format(_id_type(index)))


def phrase_hits(index: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, slop: int | None = None) -> DataFrame:
    """Per indexed document: doc_id, n_words, n_hit (words inside any phrase found), items (sorted item ids) and near.

    ``near`` has the items with a proximity match (see ``proximity_matches``), if ``slop`` is given. A benchmark of
    more than ``block_bytes`` is searched in blocks of items, whose hits are united by row.
    """
    spark = index.sparkSession
    n, collect = _blocks(items, block_bytes)
    parts = []
    for k in range(n):
        shared = spark.sparkContext.broadcast(Block(collect(k), window))
        parts.append(scratch.materialize(_search(index, shared, n > 1, slop), "hits"))
        shared.destroy()
    if n == 1:
        return parts[0].select("doc_id", "n_words", "n_hit", "items", "near")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731 - one array a block
    united = union.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *map(merged, ("hit_at", "items", "near")))
    return united.select("doc_id", "n_words", F.size("hit_at").cast("long").alias("n_hit"), F.sort_array("items").alias("items"), F.sort_array("near").alias("near"))


def proximity_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stretches that hold all words of a test phrase, in any order, with at most ``slop`` words more.

    Rows: doc_id, item_id, item_offset (of the phrase in the item), position (in the document) and span.
    """

    def look(shared) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            block = shared.value
            for batch in batches:
                for ids, *lists in rows_of(batch, "doc_ids", *_LISTS):
                    seg = Segment(*lists)
                    out: dict[str, list] = {"doc_id": [], "item_id": [], "item_offset": [], "position": [], "span": []}
                    for phrase, at, span in sorted(seg.near(block, slop)):
                        d = int(np.searchsorted(seg.starts, at, "right")) - 1
                        row = (ids[d], block.names[block.item[phrase]], int(block.offset[phrase]), at - int(seg.starts[d]), span)
                        for c, v in zip(out.values(), row, strict=True):
                            c.append(v)
                    yield out

        return map_arrow(index, search, _MATCHES.format(_id_type(index)))

    n, collect = _blocks(items, block_bytes)
    parts = []
    for k in range(n):
        shared = index.sparkSession.sparkContext.broadcast(Block(collect(k), window))
        parts.append(scratch.materialize(look(shared), "near"))
        shared.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, by the index; n_near counts the items with a proximity match."""
    with scratch.owner():
        index = scratch.materialize(build_index(table(spark, sf_dir, "documents")), "postings")
        hits = phrase_hits(index, table(spark, sf_dir, "benchmark"), slop=SLOP)
        scratch.discard(index)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark phrase; the others stay as they are.

    Rows are dropped one by one, by a 128-bit key of id and text, as ids may be null or repeated.
    """
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.concat_ws(":", *row_keys("k1", "k2")))
    with scratch.owner() as made:
        index = scratch.materialize(build_index(keyed.select(F.col(key).alias("doc_id"), "text")), "postings")
        hit = phrase_hits(index, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
        bad = scratch.materialize(hit.select(F.col("doc_id").alias(key)).distinct(), "bad")
        made.keep(bad)
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS p, least(len(w), {WINDOW}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
starts AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, i, s.n, item_id FROM starts s JOIN phrases USING (p, n)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id),
bw AS (
  SELECT DISTINCT item_id, o, n, unnest(g) AS word FROM (
    SELECT item_id, i AS o, least(len(w), {WINDOW}) AS n, w[i : i + {WINDOW} - 1] AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
size AS (SELECT item_id, o, n, count(*) AS m FROM bw GROUP BY ALL),
dp AS (SELECT doc_id, i, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) SEMI JOIN bw USING (word)),
cand AS (
  SELECT doc_id, item_id, o, n, m FROM (SELECT DISTINCT doc_id, word FROM dp) JOIN bw USING (word) JOIN size USING (item_id, o, n)
  GROUP BY doc_id, item_id, o, n, m HAVING count(*) = m),
st AS (SELECT doc_id, item_id, o, n, m, i, word FROM cand JOIN bw USING (item_id, o, n) JOIN dp USING (doc_id, word)),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT x.doc_id, x.item_id FROM st x JOIN st y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.o = y.o AND y.i BETWEEN x.i AND x.i + x.n + {SLOP} - 1
    GROUP BY x.doc_id, x.item_id, x.o, x.i, x.m HAVING count(DISTINCT y.word) = x.m)
  GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
