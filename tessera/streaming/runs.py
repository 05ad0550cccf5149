"""Stateful twins of the run-record operators for Structured Streaming.

State is one small tuple a key. Events of a key are applied in the order of
their sequence within each micro-batch, and a batch may not go back behind the
state's sequence: such rows are reported and leave the state alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.folds import Circuit
from tessera.operators.runs import TRANSITIONS


def run_states(events: DataFrame) -> DataFrame:
    """run_id, sequence, status and rule for a stream of events (run_id, sequence, status): broken transitions and gaps."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, status = state.get if state.exists else (0, "")
        out = []
        for seq, new in pd.concat(list(batches)).sort_values("sequence")[["sequence", "status"]].itertuples(index=False):
            rule = None
            if seq <= last:
                rule = "not_increasing"
            elif seq != last + 1:
                rule = "not_contiguous"
            elif not status and new != "created":
                rule = "first_not_created"
            elif status and status != new and (status, new) not in TRANSITIONS:
                rule = "transition"
            out.append((key[0], int(seq), new, rule))
            if rule != "not_increasing":
                last, status = int(seq), new
        state.update((last, status))
        yield pd.DataFrame(out, columns=["run_id", "sequence", "status", "rule"])

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id long, sequence long, status string, rule string", "last long, status string", "append", GroupStateTimeout.NoTimeout)


def circuits(calls: DataFrame, threshold: int = 3, cooldown: float = 900.0) -> DataFrame:
    """provider, ordinal, state and epoch after each call of a stream (provider, at, ordinal, outcome, retry_after)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Circuit(threshold, cooldown)
        if state.exists:
            c.failures, c.epoch, c.until = state.get
        out: list[tuple[Any, ...]] = []
        for at, ordinal, outcome, retry in pd.concat(list(batches)).sort_values(["at", "ordinal"])[["at", "ordinal", "outcome", "retry_after"]].itertuples(index=False):
            out.append((key[0], int(ordinal), c.record(float(at), outcome, None if pd.isna(retry) else float(retry)), c.epoch))
        state.update((c.failures, c.epoch, float(c.until)))
        yield pd.DataFrame(out, columns=["provider", "ordinal", "state", "epoch"])

    return calls.groupBy("provider").applyInPandasWithState(step, "provider string, ordinal long, state string, epoch int", "failures int, epoch int, until double", "append", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame) -> DataFrame:
    """The last event of each worker (loop, role, worker, at, kind), updated as events come."""
    return events.groupBy("loop", "role", "worker").agg(F.max_by("kind", "at").alias("kind"), F.max("at").alias("at"))


def first_stops(stops: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first stop request of each attempt; repeated ones within ``late`` are dropped, with bounded state."""
    return stops.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "attempt"])
