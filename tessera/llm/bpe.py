"""BPE encoding and decoding with a pair occurrence index.

The pieces that a partition has not met before are laid out in one sequence of
symbols. An index maps each mergeable pair to all its places there; active
ranks are applied in ascending order over all pieces at once, and each merge
updates only the lists of the pairs beside it. Pieces already met are looked up.

The vocabulary is read from a tokenizer file (a parameter) on the driver and
sent to the executors as text, so that they need no file of their own.

Defined results: a null text counts as empty and has no tokens; repeated rows
are encoded each for itself; null ids are kept; other columns are ignored; an
empty table gives no rows. Texts are never cut.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from tessera.llm.common import map_arrow, rows_of, sha256, table

#: Distinct pieces in each of a worker's two generations of memory, and the longest one remembered.
MEMORY = 200_000
LONGEST = 48
#: White space of the vocabulary's normaliser.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: In texts of these characters (not U+001C to U+001F, nor U+0130) normalisation changes nothing but case, and
#: Python's ``re`` agrees with the vocabulary on letters, digits and white space.
_FAST = re.compile("[\x00-\x1b\x20-įı-ɏ]*")
#: The vocabulary's own splitting rule for such texts, after lower-casing.
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")


def tokenizer_json(name: str = "word_bpe_49k.json", root: str | None = None) -> str:
    """The text of a tokenizer file, from a folder or the installed package of public ones; it is of a fixed size of a few MB."""
    if root is not None:
        return (Path(root) / name).read_text(encoding="utf-8")
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary with word ends, and what this worker remembers of it."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.token = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_rule = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.library = Tokenizer.from_str(text)
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.shift = max(self.token).bit_length()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {a << self.shift | b: r for r, (a, b, _) in enumerate(self.parts)}
        made = {new: r for r, (_, _, new) in enumerate(self.parts)}  # the last merge that makes a token
        if len(self.rank) < len(self.parts) or any(made.get(x, -1) >= r for r, (a, b, _) in enumerate(self.parts) for x in (a, b)):
            raise ValueError("a merge of this vocabulary comes before one that makes its parts, so ranks can't be applied in one pass")
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}
        self._age()

    def _age(self) -> None:
        """Start a new generation; what it needs of the last one is taken over, the rest is forgotten with the next."""
        self.old_ids, self.old_texts = self.ids, self.texts
        self.ids = {s: str(i) for s, i in self.special.items()}
        self.texts = {s: s for s in self.special}

    def merged(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of each piece.

        Places are indexed by the rank of the pair that stands there. No merge makes a pair of a lower rank than its
        own (every merge comes after those that make its parts, as was checked), so one ascending pass over all pieces is exact.
        """
        shift, rank, inner, last = self.shift, self.rank.get, self.inner, self.last
        symbol: list[int] = []
        starts = []
        for p in pieces:
            data = p.encode()
            starts.append(len(symbol))
            symbol += [inner[b] for b in data[:-1]]
            symbol += (last[data[-1]], -1)
        size = len(symbol)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        places: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(symbol, symbol[1:], strict=False)):
            if a >= 0 and b >= 0 and (r := rank(a << shift | b)) is not None:
                if r in places:
                    places[r].append(i)
                else:
                    places[r] = [i]
        active = list(places)
        heapq.heapify(active)
        push, pop = heapq.heappush, heapq.heappop
        while active:
            r = pop(active)
            here = places.pop(r)
            left, right, new = self.parts[r]
            here.sort()
            high = new << shift
            for i in here:
                j = after[i]
                if symbol[i] != left or symbol[j] != right:
                    continue
                k = after[j]
                symbol[i], symbol[j] = new, -2
                after[i], before[k] = k, i
                b = symbol[k]
                if b >= 0 and (q := rank(high | b)) is not None:
                    if q in places:
                        places[q].append(i)
                    else:
                        places[q] = [i]
                        push(active, q)
                h = before[i]
                if h >= 0 and (a := symbol[h]) >= 0 and (q := rank(a << shift | new)) is not None:
                    if q in places:
                        places[q].append(h)
                    else:
                        places[q] = [h]
                        push(active, q)
        out = []
        for i in starts:
            ids = []
            while symbol[i] != -1:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens, as the vocabulary's own normaliser and splitter give them."""
        if _FAST.fullmatch(text):
            return _PIECES.findall(text.lower())
        out = []
        for chunk in _WHITE.split(text):
            if _FAST.fullmatch(chunk):
                out += _PIECES.findall(chunk.lower())
            else:
                known = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
                out += [bytes(self.byte_of[c] for c in p).decode() for p, _ in known]
        return out

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; special tokens are pieces of their own."""
        if not any(s in text for s in self.special):
            return self.pieces(text)
        out = []
        for part in self.special_rule.split(text):
            out += [part] if part in self.special else self.pieces(part)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't remembered."""
        if len(self.ids) > MEMORY:
            self._age()
        missing = []
        for p in pieces.difference(self.ids):
            if p in self.old_ids:
                self.ids[p], self.texts[p] = self.old_ids[p], self.old_texts[p]
            else:
                missing.append(p)
        for p, ids in zip(missing, self.merged(missing), strict=True):
            self.ids[p] = " ".join(map(str, ids))
            self.texts[p] = self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; this vocabulary has no decoder, so its tokens are joined by spaces."""
        return " ".join([self.token[i] for i in ids])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text its ids, and their decoding, each joined by spaces."""
        cut = [self.cut(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        ids, back = self.ids.__getitem__, self.texts.__getitem__
        for pieces in cut:
            yield " ".join(map(ids, pieces)), " ".join(map(back, pieces))
        for p in [p for p in self.ids if len(p) > LONGEST and p not in self.special]:
            del self.ids[p], self.texts[p]


_ready: dict[int, Bpe] = {}


def _bpe(text: str) -> Bpe:
    """One vocabulary a worker."""
    key = hash(text)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Bpe(text)
    return _ready[key]


def _count(ids: str) -> int:
    return ids.count(" ") + 1 if ids else 0


def encode(docs: DataFrame, spec: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(spec or tokenizer_json())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = _bpe(shared.value)
        for batch in batches:
            found = bpe.encode(batch.column("text").to_pylist())
            yield {"doc_id": batch.column("doc_id"), "ids": [[int(i) for i in s.split()] for s, _ in found]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, spec: str | None = None) -> DataFrame:
    """doc_id and text of every ids array (null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(spec or tokenizer_json())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = _bpe(shared.value)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "text": [bpe.decode(ids or []) for _, ids in rows_of(batch, "doc_id", "ids")]}

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, spec: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(spec or tokenizer_json())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = _bpe(shared.value)
        for batch in batches:
            counts, ids, back = [], [], []
            for i, d in bpe.encode(batch.column("text").to_pylist()):
                counts.append(_count(i))
                ids.append(sha256(i))
                back.append(sha256(d))
            yield {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": back}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the lower-case word vocabulary."""
    return digests(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that reached this stage; a row each, also for null or repeated ids."""
    return encode(docs)
