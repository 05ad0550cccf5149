from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.llm import helpers as H
from tessera.llm import common, decontaminate, jaccard_join, line_dedup, substring_dedup
from tessera.llm.common import hash_words, hot_keys, spread_join, window_hashes


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    rng = random.Random(request.param)
    out = H.awkward(rng)
    # a crowd of near copies, of which not all are alike enough, and a passage in many documents
    base, passage = H.words(rng, 80, 4000), H.words(rng, 50, 4000)
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
        out.append((100 + i, " ".join(w), "de", "t", 0))
        out.append((200 + i, " ".join(passage + H.words(rng, rng.randrange(60), 4000)), "de", "t", 0))
    return out


def test_jaccard(spark, rows):
    found = jaccard_join.jaccard_components(H.with_clashes(H.frame(spark, rows)))
    assert H.ordered(found.collect()) == H.ordered(H.components(rows))


def test_jaccard_with_everything_dealt_over_parts(spark, rows, monkeypatch):
    """With few rows a part, each join of postings, pairs, components and copies goes through parts."""
    monkeypatch.setattr(common, "HOT_SHARE", 7)
    monkeypatch.setattr(jaccard_join, "GROUP", 2)
    found = jaccard_join.jaccard_components(H.frame(spark, rows + rows[6:8] * 5))
    assert H.ordered(found.collect()) == H.ordered(H.components(rows + rows[6:8] * 5))


def test_jaccard_with_a_filter_in_small_pieces(spark, rows, monkeypatch):
    """With few shingles gathered, few ranges and small blocks, the first filter's counts come from many pieces."""
    monkeypatch.setattr(jaccard_join, "GATHER", 50)
    monkeypatch.setattr(jaccard_join, "RANGES", (3, 5))
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    found = jaccard_join.jaccard_components(H.frame(spark, rows))
    assert H.ordered(found.collect()) == H.ordered(H.components(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_shingles_that_occur_once_are_counted_by_row(seed):
    """The pieces of the first filter against a plain count, with clashes inside a row, a piece and all pieces."""
    import pyarrow as pa
    from collections import Counter

    rng = random.Random(seed)
    top = 1 << jaccard_join.FILTER_BITS
    common = [0, top - 1, *(rng.randrange(top) for _ in range(20))]
    held = {(p << 33) + i: [rng.choice(common) if rng.random() < 0.3 else rng.randrange(top) for _ in range(rng.randrange(40))] for p in range(2) for i in range(30)}
    seen = Counter(t for of in held.values() for t in of)
    want = {r: n for r, of in held.items() if (n := sum(seen[t] == 1 for t in of))}
    table = pa.table({"row": pa.array(held, pa.int64()), "fragment": pa.array(list(held.values()), pa.list_(pa.int64()))})
    for gather, ranges, block in ((1, 1, 1), (70, 7, 16), (10**6, 1 << 14, 4096)):
        dealt = [pa.table(d) for d in jaccard_join._dealt(iter(table.to_batches(max_chunksize=9)), ranges, gather)]
        dealt = pa.concat_tables(dealt).to_pylist()
        names = ["range", "once", "owners", "more"]
        groups = [pa.table({c: [d[c] for d in dealt if d["range"] == r] for c in names}, schema=pa.schema(list(zip(names, [pa.int32()] + [pa.binary()] * 3)))) for r in {d["range"] for d in dealt}]
        alone = [x for g in groups for x in jaccard_join._alone(g, block).to_pylist()]
        got = {}
        for b in {x["block"] for x in alone}:
            of = pa.table({c: [x[c] for x in alone if x["block"] == b] for c in ("block", "places")})
            for x in jaccard_join._lacking(of, block).to_pylist():
                assert x["row"] not in got
                got[x["row"]] = x["lacking"]
        assert got == want


def test_first_filter_moves_few_bytes_a_shingle(spark, tmp_path):
    """Unrelated texts, of which only the filter's shingles are shuffled: that stays near their size, with many partitions too."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(600)), "en", "s", 0) for i in range(1500)]
    H.frame(spark, rows).coalesce(2).write.parquet(f"{tmp_path}/d")
    executors = spark.sparkContext._jsc.sc().statusStore().executorList
    written = lambda: sum(executors(True).apply(i).totalShuffleWrite() for i in range(executors(True).size()))
    before, parts = written(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert jaccard_join.jaccard_components(spark.read.parquet(f"{tmp_path}/d")).where("doc_id = component_id").count() == 1500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert 0 < written() - before < 14 * 1500 * 596 * jaccard_join.SHARE


def test_jaccard_stage_keeps_one_of_each(spark, rows):
    docs = H.frame(spark, [r for r in rows if r[0] is not None])
    kept = jaccard_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = {r[0] for r, c in zip(rows, H.components(rows), strict=True) if r[0] is not None and (c[1] == 0 or c[2] == r[0])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_substrings(spark, rows):
    found = substring_dedup.remove_repeats(H.with_clashes(H.frame(spark, rows)))
    assert H.ordered(found.collect()) == H.ordered(H.without_repeats(rows))


@pytest.mark.parametrize(("window", "shortest"), [(8, 2), (35, 5), (20, 20)])
def test_substring_levels(spark, rows, window, shortest):
    assert substring_dedup.level_lengths(window, shortest)[-1] == window
    found = substring_dedup.remove_repeats(H.frame(spark, rows), window, shortest)
    assert H.ordered(found.collect()) == H.ordered(H.without_repeats(rows, window))


def test_substrings_tell_clashing_hashes_apart(rows, monkeypatch):
    """With a first half of few bits the levels let more through, and the whole hash still decides."""
    from collections import Counter

    # the lowest bit of a text's hashes tells which half is meant: even ones, the first half, keep six bits only
    monkeypatch.setattr(substring_dedup, "hash_words", lambda w, second=False: hash_words(w, second) & ~np.uint64(1) | np.uint64(second))
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda h, n: window_hashes(h, n) >> np.uint64(0 if h[0] & np.uint64(1) else 58))
    texts = [substring_dedup.white_words(t) for _, t, *_ in rows]
    known, shorter = [[]] * len(texts), None
    for length in substring_dedup.level_lengths(35)[:-1]:
        found = [None if shorter and not k else substring_dedup.judged(w, 35, shorter, length, k) for w, k in zip(texts, known, strict=True)]
        seen = Counter(x for f in found if f is not None for x in f.tolist())
        known, shorter = [[] if f is None else [x for x in set(f.tolist()) if seen[x] > 1] for f in found], length
    found = [substring_dedup.whole_windows(w, 35, substring_dedup._alive(substring_dedup.hash_words(w), 35, shorter, k)) if k else None for w, k in zip(texts, known, strict=True)]
    seen = Counter(x for f in found if f is not None for x in zip(f[0].tolist(), f[1].tolist(), strict=True))
    places = [[] if f is None else [p for a, b, p in zip(*(x.tolist() for x in f), strict=True) if seen[a, b] > 1] for f in found]
    gone = [int(substring_dedup.covered_words(len(w), np.array(p), 35).sum()) if p else 0 for w, p in zip(texts, places, strict=True)]
    assert len({a for f in found if f is not None for a in f[0].tolist()}) <= 64
    assert gone == [r[2] for r in H.without_repeats(rows)] and any(gone)


def test_repeat_lengths(spark, rows):
    want = []
    for r in rows:
        length = 0
        while any(x[2] for x, y in zip(H.without_repeats(rows, 8 * 2**length), rows, strict=True) if y is r):
            length += 1
        if length:
            want.append((r[0], 8 * 2 ** (length - 1)))
    assert H.ordered(substring_dedup.repeat_lengths(H.with_clashes(H.frame(spark, rows))).collect()) == H.ordered(want)
    assert substring_dedup.repeat_lengths(H.frame(spark, [(1, "a b", "", "", 0)])).count() == 0


@pytest.mark.parametrize("least", [2, 10])
def test_lines(spark, rows, least):
    docs = H.with_clashes(H.frame(spark, rows + [(900 + i, f" Common Line\nrow {i}\n\ncommon line\n", "en", "s", 0) for i in range(12)]))
    plain = [tuple(r[:5]) for r in docs.collect()]
    found = line_dedup.dedup_lines(docs, least, names=("a", "b", "c")).select("doc_id", "a", "b", "c")
    assert H.ordered(found.collect()) == H.ordered(H.kept_lines(plain, least))


def test_line_stage_keeps_columns(spark, rows):
    docs = H.with_clashes(H.frame(spark, rows + [(900 + i, f"Common Line\nrow {i}", "en", "s", 9) for i in range(12)]))
    out = line_dedup.stage(spark, docs, "")
    assert out.schema.names == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.where("doc_id >= 900").collect()} == {f"row {i}" for i in range(12)}


def test_many_lines_in_one_document(spark):
    text = "\n".join(f"l{i % 150}" for i in range(400))
    rows = [(i, text, "en", "s", 0) for i in range(11)] + [(99, "\n".join(f"m{i}" for i in range(300)), "en", "s", 0)]
    found = line_dedup.dedup_lines(H.frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept")
    assert H.ordered(found.collect()) == H.ordered(H.kept_lines(rows))


def test_a_hot_line_and_a_hot_key_are_dealt_over_tasks(spark):
    """A line in all documents is sorted in several ranges; its rows meet its key in several parts."""
    rows = [(i, f"hot\nown {i}\nhot", "en", "s", 0) for i in range(3000)]
    docs = H.frame(spark, rows).repartition(4)
    lines = line_dedup.line_rows(docs)
    ranged = lines.repartitionByRange(4, "h1", "h2", "k1", "k2").withColumn("p", F.spark_partition_id())
    hot = ranged.groupBy("h1", "p").count().groupBy("h1").agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("n")).where("n = 6000").collect()
    assert [r.parts > 1 for r in hot] == [True]
    often = line_dedup.scratch.materialize(line_dedup.frequent_lines(lines), "often")
    assert [r.n for r in often.collect()] == [3000]
    keys = hot_keys(often, ["h1", "h2"], "n", 9000)
    assert [k[2] for k in keys] == [334] and not hot_keys(often, ["h1", "h2"], "n", 9_000_000)
    dealt = spread_join(lines, often, ["h1", "h2"], keys, ["k1", "k2"])
    assert dealt.columns == lines.columns and dealt.count() == 6000
    out = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept")
    assert H.ordered(out.collect()) == H.ordered(H.kept_lines(rows))


ITEMS = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (2, "One two"), (10, None), (11, ""), (None, "same line same line same line same line same line"), (3, "x")]


def test_phrases(spark, rows):
    docs = H.frame(spark, rows + [(500, "a W1-w2, w3 w4 w5 w6 w7 w8 w9 w10 b one TWO", "en", "s", 0)])
    plain = [tuple(r) for r in docs.collect()]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = H.ordered(H.hits(plain, ITEMS))
    for tokens, block in ((1_000_000, 1 << 20), (700, 1 << 20), (1_000_000, 30)):
        index = decontaminate.scratch.materialize(decontaminate.build_index(H.with_clashes(docs), tokens), "test")
        found = decontaminate.phrase_hits(index, items, block_bytes=block)
        assert H.ordered((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()) == want


def test_proximity(spark):
    docs = H.frame(spark, [(1, "z b x a y c z", "", "", 0), (2, "a b", "", "", 0), (3, "a z z z z z b z z z c", "", "", 0)])
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    found = decontaminate.proximity_matches(index, items, slop=2).collect()
    assert [(r.doc_id, r.item_id, r.position, r.span) for r in found] == [(1, "7", 1, 5)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segment_search_is_the_plain_one(seed, monkeypatch):
    """Phrases and proximity of one segment by comparing all places; few words, so that all lists are long."""
    monkeypatch.setattr(decontaminate, "STEP", 7)
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(12)]
    items = [(str(i), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9)))) for i in range(25)] + [("z", "q"), ("y", None), ("x", "a")]
    words = [t.encode().split() for t in texts]
    made = decontaminate._segment(list(range(12)), [len(w) for w in words], [w for of in words for w in of])
    seg = decontaminate.Segment(made["n_words"][0], made["terms"][0], made["ends"][0], made["gaps"][0])
    block = decontaminate.Block(items, 4)
    want, close = set(), set()
    for i, (_, t) in enumerate(items):
        w = (t or "").encode().split()
        for o in range(max(1, len(w) - 3)) if w else ():
            p, need = w[o : o + 4], set(w[o : o + 4])
            for d, of in enumerate(words):
                for k in range(len(of)):
                    if of[k : k + len(p)] == p:
                        want.add((i, o, int(seg.starts[d]) + k))
                    if of[k] in need and need <= set(of[k : k + len(p) + 2]):
                        close.add((i, o, d))
    phrase, at = seg.phrases(block)
    assert {(int(block.item[p]), int(block.offset[p]), int(x)) for p, x in zip(phrase, at, strict=True)} == want
    near = seg.near(block, 2)
    assert {(int(block.item[p]), int(block.offset[p]), int(np.searchsorted(seg.starts, x, "right")) - 1) for p, x, _ in near} == close
    assert all(span <= block.length[p] + 2 for p, _, span in near)


def test_proximity_ends_with_the_document(spark):
    texts = ["b x x a", "b", "a", "", "b y a", "b"]  # across the border after the first, a and b would be closer
    docs = H.frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)]).coalesce(1)
    items = spark.createDataFrame([(7, "a b")], "item_id long, text string")
    found = decontaminate.proximity_matches(decontaminate.build_index(docs), items, slop=2).collect()
    assert sorted((r.doc_id, r.position, r.span) for r in found) == [(0, 0, 4), (4, 0, 3)]


def test_empty_tables(spark):
    none = H.frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.jaccard_components(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert decontaminate.phrase_hits(decontaminate.build_index(none), items).count() == 0
    some = H.frame(spark, [(1, "a b", "", "", 0)])
    assert [r.n_hit for r in decontaminate.phrase_hits(decontaminate.build_index(some), items).collect()] == [0]


def test_stages_tell_rows_without_ids_apart(spark, tmp_path):
    rng = random.Random(6)
    item, base = " ".join(H.words(rng, 12, 4000)), H.words(rng, 80, 4000)
    clean = [" ".join(H.words(rng, 40, 4000)) for _ in range(3)]
    near = [" ".join([*base, f"tail{k}"]) for k in range(3)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hit = [(None, f"x {item} y", "", "", 0), (7, f"z {item}", "", "", 0)]
    stay = [(None, clean[0], "", "", 0), (None, clean[1], "", "", 0), (7, clean[2], "", "", 0), (None, None, "", "", 0)]
    docs = H.with_clashes(H.frame(spark, hit + stay))
    kept = decontaminate.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and H.ordered((r.doc_id, r.text) for r in kept.collect()) == H.ordered(r[:2] for r in stay)
    crowd = [(None, t, "", "", 0) for t in near]
    kept = [(r.doc_id, r.text) for r in jaccard_join.stage(spark, H.with_clashes(H.frame(spark, crowd + stay)), "").collect()]
    assert sum(t in near for _, t in kept) == 1 and H.ordered(k for k in kept if k[1] not in near) == H.ordered(r[:2] for r in stay)
    same_id = [(3, near[0], "", "", 0), (3, near[1], "", "", 0), (None, near[2], "", "", 0), (3, clean[0], "", "", 0)]
    kept = [(r.doc_id, r.text) for r in jaccard_join.stage(spark, H.frame(spark, same_id), "").collect()]
    assert len(kept) == 2 and {i for i, _ in kept} == {3} and (3, clean[0]) in kept
