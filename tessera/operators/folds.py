"""Operators that depend on order within a group, as grouped-map folds over pandas batches.

A group is a document, a run or a provider; a fold sees one group at a time.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions.json_tools import invented_numbers, schema_errors, values_in

#: Failures that open a circuit at once, and those that count towards the threshold.
AT_ONCE, COUNTED = frozenset({"authentication", "quota", "rate_limit"}), frozenset({"transport", "unavailable"})


class Circuit:
    """closed until failures open it; open until the cooldown ends; then one probe decides."""

    def __init__(self, threshold: int = 3, cooldown: float = 900.0):
        self.threshold, self.cooldown = threshold, cooldown
        self.failures, self.epoch, self.until, self.probing = 0, 0, 0.0, False

    def state(self, now: float) -> str:
        return "closed" if not self.until else "open" if now < self.until else "half_open"

    def record(self, now: float, outcome: str, retry_after: float | None = None, epoch: int | None = None) -> str:
        """The state after an outcome; a success that began in an earlier epoch changes nothing."""
        if outcome == "success":
            if epoch is None or epoch == self.epoch:
                if self.until:
                    self.epoch += 1
                self.failures, self.until = 0, 0.0
        elif outcome in AT_ONCE or outcome in COUNTED:
            self.failures += 1
            if outcome in AT_ONCE or self.failures >= self.threshold or self.until:
                self.epoch += 1
                wait = self.cooldown if retry_after is None else min(3600.0, max(1.0, retry_after))
                self.until = max(self.until, now + wait)
        return self.state(now)


def circuit_states(calls: DataFrame, threshold: int = 3, cooldown: float = 900.0) -> DataFrame:
    """State and epoch after each call (provider, at as seconds, ordinal, outcome, retry_after, epoch)."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["at", "ordinal"], kind="stable")
        c, out = Circuit(threshold, cooldown), []
        for provider, at, ordinal, outcome, retry, epoch in g[["provider", "at", "ordinal", "outcome", "retry_after", "epoch"]].itertuples(index=False):
            state = c.record(at, outcome, None if pd.isna(retry) else retry, None if pd.isna(epoch) else int(epoch))
            out.append((provider, ordinal, state, c.epoch))
        return pd.DataFrame(out, columns=["provider", "ordinal", "state", "epoch"])

    return calls.groupBy("provider").applyInPandas(fold, "provider string, ordinal long, state string, epoch int")


def prefix_chain(artifacts: DataFrame) -> DataFrame:
    """session, ordinal, prefix: each the SHA-256 of the one before, a NUL and the artifact's digest."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ordinal", kind="stable")
        prefix, out = hashlib.sha256(b"").hexdigest(), []
        for s, o, d in g[["session", "ordinal", "digest"]].itertuples(index=False):
            prefix = hashlib.sha256(f"{prefix}\0{d}".encode()).hexdigest()
            out.append((s, o, prefix))
        return pd.DataFrame(out, columns=["session", "ordinal", "prefix"])

    return artifacts.groupBy("session").applyInPandas(fold, "session long, ordinal long, prefix string")


def admitted(resources: DataFrame, each: int, total: int, count: int) -> DataFrame:
    """bundle, ordinal and code (admitted, repeated, too_large, over_total, over_count) of resources (digest, size) in order.

    What is admitted depends on what was admitted before; a repeated digest costs nothing.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        used, seen, out = 0, set(), []
        for b, o, d, s in g.sort_values("ordinal", kind="stable")[["bundle", "ordinal", "digest", "size"]].itertuples(index=False):
            code = "repeated" if d in seen else "too_large" if s > each else "over_count" if len(seen) >= count else "over_total" if used + s > total else "admitted"
            if code == "admitted":
                used, _ = used + s, seen.add(d)
            out.append((b, o, code))
        return pd.DataFrame(out, columns=["bundle", "ordinal", "code"])

    return resources.groupBy("bundle").applyInPandas(fold, "bundle long, ordinal long, code string")


def _match_keys(span: dict) -> list[tuple]:
    """What a span may be matched by, best first."""
    label = [("label", span["label"])] if span["label"] else []
    return [*label, ("kind", span["kind"], span["tex"]), ("tex", span["tex"])]


def reconcile(primary: DataFrame, validator: DataFrame) -> DataFrame:
    """Formula spans (doc_id, ordinal, kind, tex, label, context) of two renditions, matched greedily in the primary's order.

    A span is matched by label, else by kind and formula, else by formula; of several candidates the one with the
    same context, else the first; each is used once. Rows: doc_id, ordinal, status (verified, mismatch, missing,
    unmatched) and validator (ordinal). Validator spans that were never used are unmatched.
    """

    def fold(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = right.sort_values("ordinal", kind="stable").to_dict("records")
        used = [False] * len(free)
        places: dict[tuple, list[int]] = {}  # of spans by what they may be matched by, with and without the context; last first
        for i in range(len(free) - 1, -1, -1):
            for k in _match_keys(free[i]):
                places.setdefault(k, []).append(i)
                places.setdefault((*k, free[i]["context"]), []).append(i)

        def first(k: tuple) -> int | None:
            at = places.get(k, [])
            while at and used[at[-1]]:
                at.pop()
            return at[-1] if at else None

        out = []
        for p in left.sort_values("ordinal", kind="stable").to_dict("records"):
            found = next((k for k in _match_keys(p) if first(k) is not None), None)
            if found is None:
                out.append((key[0], p["ordinal"], "missing", None))
                continue
            same = first((*found, p["context"]))
            best = first(found) if same is None else same
            used[best] = True
            out.append((key[0], p["ordinal"], "verified" if free[best]["tex"] == p["tex"] else "mismatch", free[best]["ordinal"]))
        out += [(key[0], None, "unmatched", v["ordinal"]) for v, u in zip(free, used, strict=True) if not u]
        return pd.DataFrame(out, columns=["doc_id", "ordinal", "status", "validator"]).astype({"ordinal": "Int64", "validator": "Int64"})

    schema = "doc_id long, ordinal long, status string, validator long"
    return primary.groupBy("doc_id").cogroup(validator.groupBy("doc_id")).applyInPandas(fold, schema)


def align(left: list[str], right: list[str]) -> tuple[list[tuple[int, int]], bool]:
    """The longest in-order matching of equal titles, and whether it is the only one."""
    n, m = len(left), len(right)
    best = [[(0, 1)] * (m + 1) for _ in range(n + 1)]  # length and number of different matchings of that length, capped at two
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            take = (best[i + 1][j + 1][0] + 1, best[i + 1][j + 1][1]) if left[i] == right[j] else (-1, 0)
            down, across, both = best[i + 1][j], best[i][j + 1], best[i + 1][j + 1]
            top = max(take[0], down[0], across[0])
            ways = (take[1] if take[0] == top else 0) + (down[1] if down[0] == top else 0) + (across[1] if across[0] == top else 0)
            ways -= both[1] if both[0] == top else 0  # counted by both of the steps that skip
            best[i][j] = (top, min(max(ways, 1), 2))
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if left[i] == right[j] and best[i][j][0] == best[i + 1][j + 1][0] + 1:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j][0] >= best[i][j + 1][0]:
            i += 1
        else:
            j += 1
    return pairs, best[0][0][1] == 1


def aligned(outline: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, entry, heading of matched titles (doc_id, ordinal, title); an ambiguous document has a row with an error only."""

    def fold(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("ordinal"), b.sort_values("ordinal")
        pairs, only = align(list(a["title"]), list(b["title"]))
        rows = [(key[0], int(a["ordinal"].iloc[i]), int(b["ordinal"].iloc[j]), None) for i, j in pairs] if only else [(key[0], None, None, "alignment_ambiguous")]
        return pd.DataFrame(rows, columns=["doc_id", "entry", "heading", "error"]).astype({"entry": "Int64", "heading": "Int64"})

    return outline.groupBy("doc_id").cogroup(headings.groupBy("doc_id")).applyInPandas(fold, "doc_id long, entry long, heading long, error string")


def json_candidates(texts: DataFrame, schema: dict) -> DataFrame:
    """id, ordinal, value (JSON) and valid for each JSON value found in a text (id, text)."""
    import json

    def run(batches):
        for batch in batches:
            rows = [(i, k, json.dumps(v, ensure_ascii=False), next(schema_errors(v, schema), None) is None) for i, t in batch[["id", "text"]].itertuples(index=False) for k, v in enumerate(values_in(t or ""))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "value", "valid"])

    return texts.select("id", "text").mapInPandas(run, "id long, ordinal int, value string, valid boolean")


def fabricated(outputs: DataFrame) -> DataFrame:
    """id, path and number for numbers in an output (JSON) that its source doesn't have: outputs are (id, value, source)."""
    import json

    def run(batches):
        for batch in batches:
            rows = [(i, p, n) for i, v, s in batch[["id", "value", "source"]].itertuples(index=False) for p, n in invented_numbers(json.loads(v), s or "")]
            yield pd.DataFrame(rows, columns=["id", "path", "number"])

    return outputs.select("id", "value", "source").mapInPandas(run, "id long, path string, number string")
