"""N-gram Jaccard join by vertical partitioning.

The distinct shingles of a text form its set. Sets are collapsed to classes of
equal sets first. Two filters that lose no link narrow the classes: of a set
that has a partner, all but a quarter of the shingles occur elsewhere; that is
counted over one fragment of the hash order for all sets, and then over all
shingles of the sets that remain. These are sorted in one global order (rarest
shingle first), which pivots cut into fragments; for each candidate pair every
fragment counts its own partial overlap, and the sum per pair decides.

Candidate pairs share a shingle of both prefixes. They are not all listed:
a shingle's classes are first compared with one hub, links are contracted to
components, and after that only pairs that still lie in different components are
listed, in parts, so that a link found in one part saves the rest. So a group of near copies costs pairs in proportion to its size,
and no link between different components is missed.

Defined results: a text of fewer words than a shingle is one shingle; null and
empty texts, or texts without words, have no shingles, link with nothing and are
their own component; repeated rows are copies of each other; a null id never
wins as the smallest id, and is the component's id only where no other exists;
other columns are ignored; an empty table gives no rows.

Rows and sets are told apart by 128 bits, classes by numbers of a written
table. Shingles have 64-bit hashes, which are compared only within a pair of
sets: a pair of a thousand shingles each is off by one with a probability of
10^-13. Rows of a frequent shingle, a large component or a large group of
copies are dealt over parts that grow in number with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm.common import LOWER, LOWER_TABLE, UPPER, fresh, hash_words, hot_keys, map_arrow, raw, row_keys, spread_join, table, window_hashes
from tessera.llm.graph import components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
FRAGMENTS = 4
#: Rounds in which a shingle's classes are compared with a hub only.
HUB_ROUNDS = 2
#: The other pairs are tried in slices one after another, as one link is enough to join components. Classes have one of
#: SIDES numbers by hash, and a pair lies in the slice of the sum of both (modulo SIDES), however components change.
SIDES = 16
SLICES = ((0, 2), (2, 8), (8, 16))
#: Postings of a shingle that meet in one task; those of a more frequent one are dealt over parts.
GROUP = 256
#: The first filter looks at the shingles in this share of the range of hashes.
SHARE = 0.4
#: Bits of a shingle's hash that the first filter counts; a clash there only lets more through.
FILTER_BITS = 48
#: Shingles that a task of the first filter gathers before it deals them out; those met more than once meanwhile are one.
GATHER = 1 << 20
#: The first filter counts in ranges of shingles: RANGES[0] at least, then as many as leave GATHER to each, up to RANGES[1].
RANGES = (1 << 10, 1 << 14)
#: Rows, one after another by number, whose shingles that occur once are added up together.
BLOCK = 4096


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    h = hash_words(raw(text).translate(LOWER_TABLE).split())
    return np.unique(window_hashes(h, min(size, len(h)))) if len(h) else h


def _enough(a, b, overlap):
    """overlap / (a + b - overlap) >= PERCENT / 100, in whole numbers."""
    return (100 + PERCENT) * overlap >= PERCENT * (a + b)


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """Each row's set size, 128-bit digest of its set, and its shingles in the first fragment of the hash order."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        mask, end = np.uint64((1 << FILTER_BITS) - 1), np.uint64(int(SHARE * (1 << 64)))
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            yield {
                **{c: batch.column(c) for c in ("doc_id", "k1", "k2")}, "n": [len(s) for s in sets],
                "d1": np.array([d & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64),
                "d2": np.array([d >> 64 for d in digests], np.uint64).view(np.int64),
                "fragment": [(s[: np.searchsorted(s, end)] & mask).view(np.int64) for s in sets],
            }

    return map_arrow(docs, sketch, "doc_id long, k1 long, k2 long, n long, d1 long, d2 long, fragment array<long>")


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers: the least, then what each exceeds it by, byte by byte without the bytes that are 0 in all."""
    if not len(x):
        return b""
    least = x.min()
    rest = x - least
    width = max(1, (int(rest.max()).bit_length() + 7) // 8)
    return least.astype("<u8").tobytes() + bytes([width]) + rest.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(data[8], -1)
    rest = np.zeros((planes.shape[1], 8), np.uint8)
    rest[:, : data[8]] = planes.T
    return rest.view("<u8").ravel() + np.frombuffer(data, "<u8", 1)


def _pack_ascending(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _starts(x: np.ndarray) -> np.ndarray:
    """Flags of the first of equal entries; ``x`` is sorted."""
    flags = np.ones(len(x), bool)
    flags[1:] = x[1:] != x[:-1]
    return flags


def _spans(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal entries; ``x`` is sorted."""
    at = np.flatnonzero(_starts(x))
    return zip(x[at].tolist(), at.tolist(), np.append(at, len(x))[1:].tolist(), strict=True)


def _dealt(batches: Iterator[pa.RecordBatch], ranges: int, gather: int) -> Iterator[dict]:
    """Ranges of shingles, of about ``gather`` at a time: those met once then, with their rows, and those met more often."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        column = batch.column("fragment")
        token = column.flatten().to_numpy().view(np.uint64)
        held.append((token, np.repeat(batch.column("row").to_numpy().view(np.uint64), column.value_lengths().to_numpy())))
        size += len(token)
        if size >= gather:
            yield _ranged(held, ranges)
            held, size = [], 0
    if size:
        yield _ranged(held, ranges)


def _ranged(held: list[tuple[np.ndarray, np.ndarray]], ranges: int) -> dict:
    token, owner = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    first = _starts(token)
    once = first & np.append(first[1:], True)
    token, owner, once = token[first], owner[first], once[first]
    out: dict[str, list] = {"range": [], "once": [], "owners": [], "more": []}
    for r, a, b in _spans(token * np.uint64(ranges) >> np.uint64(FILTER_BITS)):
        of, one = token[a:b], once[a:b]
        for c, v in zip(out, (r, _pack_ascending(of[one]), _pack(owner[a:b][one]), _pack_ascending(of[~one])), strict=True):
            out[c].append(v)
    return out


def _alone(dealt: pa.Table, block: int) -> pa.Table:
    """For each block of rows, the place of the row of each of its shingles that occurs once in all."""
    read = lambda c, of: np.concatenate([of(x) for x in dealt[c].to_pylist()])
    token, owner, more = read("once", _unpack_ascending), read("owners", _unpack), read("more", _unpack_ascending)
    order = np.argsort(token)
    token = token[order]
    first = _starts(token)
    once = first & np.append(first[1:], True)[: len(token)] & ~np.isin(token, more)
    rows = np.sort(owner[order][once])
    blocks, places = rows // np.uint64(block), rows % np.uint64(block)
    out = [(v, _pack_ascending(places[a:b])) for v, a, b in _spans(blocks)]
    return pa.table({"block": pa.array([v for v, _ in out], pa.int64()), "places": pa.array([p for _, p in out], pa.binary())})


def _lacking(alone: pa.Table, block: int) -> pa.Table:
    """The rows of a block with the number of their shingles that occur once."""
    counts = np.zeros(block, np.int64)
    for p in alone["places"].to_pylist():
        counts += np.bincount(_unpack_ascending(p).astype(np.int64), minlength=block)
    at = np.flatnonzero(counts)
    return pa.table({"row": pa.array(alone["block"][0].as_py() * block + at, pa.int64()), "lacking": pa.array(counts[at], pa.int64())})


def _may_link(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that lack no more shingles of the fragment elsewhere than a link may lack in all.

    A shingle that occurs once brings its row along in the count, so the sets' shingles are joined with nothing. What is
    dealt out is packed: ranges of shingles with their rows, then blocks of rows; so a shingle takes a few bytes on disk,
    however many partitions there are. Shingles are counted by part of a hash, as a clash there only lets more through.
    """
    share = int((sketches.agg(F.sum("n")).first()[0] or 0) * SHARE)
    ranges, gather, block = min(max(RANGES[0], share // GATHER), RANGES[1]), GATHER, BLOCK
    dealt = map_arrow(sketches.select("row", "fragment"), lambda batches: _dealt(batches, ranges, gather), "range int, once binary, owners binary, more binary")
    alone = dealt.groupBy("range").applyInArrow(lambda t: _alone(t, block), "block long, places binary")
    lacking = alone.groupBy("block").applyInArrow(lambda t: _lacking(t, block), "row long, lacking long")
    # a class of several rows has no shingle that occurs once
    may = classes.join(lacking, "row", "left").na.fill(0, ["lacking"]).where(F.col("lacking") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100))
    return may.select("cid", "rep.k1", "rep.k2")


def _graded(sets: DataFrame) -> DataFrame:
    """(cid, n, token, df, at, score) of the shingles of two classes or more; ``at`` counts from 1 along the global order.

    The order is by df, then hash. A set's other shingles come first in it and only count in ``n`` and ``at``. Sets
    of which too few shingles are shared are left out. The score is the mean logarithm of df.
    """
    flat = sets.select("cid", "n", F.explode("tokens").alias("token"))
    df = scratch.materialize(flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    total = sets.agg(F.sum("n")).first()[0] or 0
    whole = Window.partitionBy("cid")
    shared = F.count(F.lit(1)).over(whole)
    graded = spread_join(flat, df, ["token"], hot_keys(df, ["token"], "df", total), ["cid"], "inner").select(
        "cid", "n", "token", "df", shared.alias("shared"), (F.sum(F.log("df")).over(whole) / F.col("n")).alias("score"),
        F.row_number().over(whole.orderBy("df", "token")).alias("r"),
    )
    kept = graded.where(F.col("shared") * 100 >= F.col("n") * PERCENT)
    return kept.select("cid", "n", "token", "df", (F.col("n") - F.col("shared") + F.col("r")).alias("at"), "score")


def _segments(graded: DataFrame, fragments: int) -> DataFrame:
    """(cid, fragment, segment): each set cut at the pivots of the global order."""
    place = F.col("df") + (F.col("token").cast("double") / F.lit(float(1 << 64)) + 0.5)
    share = [i / fragments for i in range(1, fragments)]
    pivots = graded.agg(F.percentile_approx(place, share, 1000)).first()[0] or []
    fragment = sum(((place >= F.lit(p)).cast("int") for p in sorted(set(pivots))), F.lit(0))
    return graded.groupBy("cid", fragment.alias("fragment")).agg(F.collect_list("token").alias("segment"))


def _postings(graded: DataFrame) -> DataFrame:
    """(token, cid, n, score, at, parts, part) for the shared shingles of each set's prefix; GROUP rows of a token make a part."""
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    parts = F.ceil(F.col("df") / GROUP).cast("int")
    rows = graded.where(F.col("at") <= prefix).withColumn("parts", parts)
    return rows.select("token", "cid", "n", "score", "at", "parts", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"))


_POSTING = ("token", "cid", "n", "score", "at", "parts", "part")


def _each_part(tokens: DataFrame) -> DataFrame:
    """What is known of a token, once for each part of its postings."""
    return tokens.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _possible():
    """Whether a pair of postings x, y can still reach the overlap, if theirs is the first shared shingle."""
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1
    return (F.col("x.cid") != F.col("y.cid")) & _enough(F.col("x.n"), F.col("y.n"), rest)


def _pair():
    a, b = F.struct("x.cid", "x.n"), F.struct("y.cid", "y.n")
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _flat_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a.cid").alias("a"), F.col("a.n").alias("na"), F.col("b.cid").alias("b"), F.col("b.n").alias("nb")).distinct()


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Partial overlaps counted fragment by fragment and summed per pair; the pairs that link stay.

    ``pairs`` is a written table; those of a class that is in many are dealt over parts.
    """
    total = pairs.count()
    hot = {c: hot_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("p")), [c], "p", total) for c in "ab"}
    of = lambda c: segments.select(F.col("cid").alias(c), "fragment", F.col("segment").alias(f"s{c}"))
    left = spread_join(pairs, of("a"), ["a"], hot["a"], ["b"], "inner")
    both = spread_join(left, of("b"), ["b", "fragment"], [(c, f, n) for c, n in hot["b"] for f in range(FRAGMENTS)], ["a"], "inner")
    counts = both.select("a", "na", "b", "nb", F.size(F.array_intersect("sa", "sb")).alias("part"))
    summed = counts.groupBy("a", "na", "b", "nb").agg(F.sum("part").alias("overlap"))
    return summed.where(_enough(F.col("na"), F.col("nb"), F.col("overlap")))


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the component of their class, of the shingles that can still link two components.

    If two sets link, their first shared shingle stands within the first
    seventh of one of them at least (the places sum to no more than
    (nx + ny) / 7 + 2, or the rest of one set is too short for the overlap). So
    a shingle that is nowhere early links nothing.
    """
    if labels is None:
        rows = postings.withColumn("label", F.col("cid"))
    else:
        rows = postings.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    rows = rows.withColumn("early", (F.col("at") - 1) * (100 + PERCENT) <= F.col("n") * (100 - PERCENT))
    facts = [F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("early").alias("some")]
    open_ = rows.groupBy("token", "parts").agg(*facts).where("lo <> hi and some").select("token", "parts")
    return rows.join(_each_part(open_), ["token", "part"], "left_semi")


def _hub_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each shingle's hub with the classes of other components, and the postings without the hubs."""
    hubs = rows.groupBy("token", "parts").agg(F.max(F.struct("score", "cid", "n", "at", "label")).alias("h"))
    x, y = _each_part(hubs).select("token", "part", "h.*").alias("x"), rows.alias("y")
    met = y.join(x, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")))
    pairs = met.where((F.col("x.label") != F.col("y.label")) & _possible()).select(*_pair())
    return _flat_pairs(pairs), met.where("x.cid <> y.cid").select(*(f"y.{c}" for c in _POSTING))


def _other_pairs(rows: DataFrame, part: tuple[int, int]) -> DataFrame:
    """The pairs, within a slice, of a shingle's classes that lie in different components and may link by it.

    Components are paired before their classes, side by side, and only those
    whose longest rest can reach the overlap; so no pair inside a component or
    outside the slice is looked at. The smaller component's classes are taken
    first. One of the two classes has the shingle early.
    """
    rows = rows.withColumn("side", F.pmod(F.xxhash64(F.lit(5), "cid"), F.lit(SIDES)).cast("int"))
    facts = [F.max(F.col("n") - F.col("at") + 1).alias("rest"), F.min("n").alias("least"), F.count(F.lit(1)).alias("members")]
    p = rows.where("early").groupBy("token", "label", "side").agg(*facts)
    p = p.withColumn("sum", F.explode(F.sequence(F.lit(part[0]), F.lit(part[1] - 1)))).withColumn("meets", F.pmod(F.col("sum") - F.col("side"), F.lit(SIDES))).alias("p")
    q = rows.groupBy("token", "label", "side").agg(*facts).alias("q")
    able = _enough(F.col("p.least"), F.col("q.least"), F.least("p.rest", "q.rest"))
    meet = p.join(q, (F.col("p.token") == F.col("q.token")) & (F.col("p.meets") == F.col("q.side")) & (F.col("p.label") != F.col("q.label")) & able)
    meet = meet.select(
        F.col("p.token").alias("token"), F.col("p.label").alias("lp"), F.col("p.side").alias("sp"), F.col("q.label").alias("lq"), F.col("q.side").alias("sq"),
        (F.col("p.members") < F.col("q.members")).alias("p_first"),
    ).alias("m")
    x, y = rows.where("early").alias("x"), rows.alias("y")
    at = lambda r, end: (F.col(f"{r}.token") == F.col("m.token")) & (F.col(f"{r}.label") == F.col(f"m.l{end}")) & (F.col(f"{r}.side") == F.col(f"m.s{end}"))
    one = meet.where("p_first").join(x, at("x", "p")).join(y, at("y", "q") & _possible()).select(*_pair())
    two = meet.where("not p_first").join(y, at("y", "q")).join(x, at("x", "p") & _possible()).select(*_pair())
    return _flat_pairs(one.unionByName(two))


def jaccard_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id (the smallest id reachable by links)."""
    return labelled_components(docs, size).select("doc_id", "n_shingles", "component_id")


def labelled_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``jaccard_components`` with the row's 128-bit key (k1, k2), and label, which tells components apart whatever their ids; null without shingles."""
    rows = docs.select("doc_id", "text", *row_keys("k1", "k2"))
    with scratch.owner() as made:
        sketches = scratch.materialize(_sketches(rows, size).withColumn("row", F.monotonically_increasing_id()), "sketches")  # fixed once written
        grouped = sketches.where("n > 0").groupBy("d1", "d2").agg(
            F.min(F.struct("k1", "k2")).alias("rep"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"),
            F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"),
        )
        classes = scratch.materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")  # fixed once written
        able = scratch.materialize(_may_link(sketches, classes), "able")
        sizes = scratch.materialize(sketches.drop("fragment", "row"), "sizes")
        made.keep(sizes, classes, able)  # the fragments aren't needed any more
        with scratch.owner() as inner:
            labels = _links(rows, able, size)
            inner.keep(*([labels] if labels is not None else []))
        ids = scratch.materialize(_named(classes, labels), "ids")
        made.keep(sizes, ids)
    total = sizes.count()
    joined = spread_join(sizes, ids.drop("copies"), ["d1", "d2"], hot_keys(ids, ["d1", "d2"], "copies", total), ["k1", "k2"], "left")
    some = F.col("n") > 0
    return joined.select(
        "doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("label")).alias("label")
    )


def _links(rows: DataFrame, able: DataFrame, size: int) -> DataFrame | None:
    """(node, label): a written table of the classes that link with others, by component."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            yield {"cid": batch.column("cid"), "n": [len(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]}

    chosen = rows.join(able, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    sets = scratch.materialize(map_arrow(chosen.select("cid", "text"), full, "cid long, n long, tokens array<long>"), "sets")
    graded = scratch.materialize(_graded(sets), "graded")
    scratch.discard(sets)
    segments = scratch.materialize(_segments(graded, FRAGMENTS), "segments")
    postings = _postings(graded)
    labels, tested = None, None
    for k in range(HUB_ROUNDS + len(SLICES)):
        found = scratch.materialize(_labelled(postings, labels), "postings")
        if found.isEmpty():
            break
        if k < HUB_ROUNDS:
            pairs, postings = _hub_pairs(found)
        else:
            # a pair belongs to one slice, so after the last one each pair has been tested, or lay in one component
            pairs, postings = _other_pairs(found, SLICES[k - HUB_ROUNDS]), found.select(*_POSTING)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.materialize(pairs, "pairs")
        if k < HUB_ROUNDS:
            tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        new = scratch.materialize(_overlaps(pairs, segments).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        if not new.isEmpty():
            old = None if labels is None else labels.select(F.col("node").alias("u"), F.col("label").alias("v")).where("u <> v")
            labels = components(new if old is None else new.unionByName(old))
    return labels


def _named(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(d1, d2, copies, label, component_id) of every class; the classes of a large component are dealt over parts."""
    named = classes.select("cid", "d1", "d2", "copies", "least_id")
    if labels is None:
        return named.select("d1", "d2", "copies", F.col("cid").alias("label"), F.col("least_id").alias("component_id"))
    named = named.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = scratch.materialize(named.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    hot = hot_keys(least, ["label"], "members", classes.count())
    return spread_join(named, least.drop("members"), ["label"], hot, ["cid"], "inner").select("d1", "d2", "copies", "label", "component_id")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, five-word shingles, similarity of 0.75 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id (null only where there is no other), of several the one with the smallest key.

    Rows without shingles all stay; rows alike in id and text count as one.
    """
    key = F.struct("k1", "k2")
    with scratch.owner() as made:
        found = labelled_components(docs).where("n_shingles = 0 or doc_id <=> component_id")
        own = F.when(F.col("n_shingles") == 0, key).alias("own")
        stay = scratch.materialize(found.groupBy("label", own).agg(F.min(key).alias("key")).select("key.k1", "key.k2"), "stay")
        made.keep(stay)
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    keyed = docs.select("*", *row_keys(k1, k2))
    return keyed.join(stay.withColumnsRenamed({"k1": k1, "k2": k2}), [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*docs.columns)


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE} - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= {PERCENT} * (nx.n + ny.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""
