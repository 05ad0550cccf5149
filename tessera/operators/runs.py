"""Run records: event logs, states, work groups, usage and cost.

A run's events are ordered by sequence. Checks return the rows that break a
rule, with the name of the rule, and nothing for sound records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The changes of state that are allowed.
TRANSITIONS = (("created", "running"), ("running", "paused"), ("running", "succeeded"), ("running", "failed"), ("paused", "running"), ("failed", "running"), ("paused", "failed"))


def numbered(events: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds sequence, from 1 in each group."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def sequence_errors(events: DataFrame) -> DataFrame:
    """run_id, sequence and rule: first_not_one or not_contiguous."""
    w = Window.partitionBy("run_id").orderBy("sequence")
    previous = F.lag("sequence").over(w)
    rule = F.when(previous.isNull() & (F.col("sequence") != 1), "first_not_one").when(F.col("sequence") != previous + 1, "not_contiguous")
    return events.select("run_id", "sequence", rule.alias("rule")).where("rule is not null")


def event_ids(events: DataFrame) -> DataFrame:
    """Adds event_id: SHA-256 of the canonical JSON of what identifies an event (data is canonical JSON already)."""
    body = F.concat(F.lit('{"data":'), "data", F.lit(',"event":"'), "event", F.lit('","run_id":"'), "run_id", F.lit('","sequence":'), F.col("sequence").cast("string"), F.lit("}"))
    return events.withColumn("event_id", F.sha2(body.cast("binary"), 256))


def transition_errors(snapshots: DataFrame) -> DataFrame:
    """run_id, sequence and rule for snapshots (status, attempt, epoch) that a run can't take.

    The attempt grows by one on entering running and else stays; the recovery epoch grows by one from failed to running.
    """
    w = Window.partitionBy("run_id").orderBy("sequence")
    p = {c: F.lag(c).over(w) for c in ("status", "attempt", "epoch")}
    rows = snapshots.select("*", *(v.alias(f"p_{c}") for c, v in p.items()))
    moved = F.col("p_status") != F.col("status")
    allowed = F.lit(False)
    for a, b in TRANSITIONS:
        allowed = allowed | ((F.col("p_status") == a) & (F.col("status") == b))
    enters = moved & (F.col("status") == "running")
    rule = F.when(F.col("p_status").isNull() & (F.col("status") != "created"), "first_not_created").when(moved & ~allowed, "transition")
    rule = rule.when(F.col("attempt") != F.col("p_attempt") + enters.cast("int"), "attempt")
    rule = rule.when(F.col("epoch") != F.col("p_epoch") + (enters & (F.col("p_status") == "failed")).cast("int"), "epoch")
    return rows.select("run_id", "sequence", rule.alias("rule")).where("rule is not null")


def interrupted(runs: DataFrame, leases: DataFrame) -> DataFrame:
    """Runs that are running without a lease, as paused by an interruption."""
    return runs.where("status = 'running'").join(leases, "run_id", "left_anti").select("run_id", F.lit("paused").alias("status"), F.lit("execution_interrupted").alias("reason"))


def first_stops(stops: DataFrame) -> DataFrame:
    """The first stop request of each attempt: run_id, attempt, reason."""
    return stops.groupBy("run_id", "attempt").agg(F.min_by("reason", F.struct("at", "reason")).alias("reason"))


def last_activity(events: DataFrame) -> DataFrame:
    """Workers (loop, role, worker) whose last event since their loop's last reset is a start: with its time.

    Events: loop, role, worker, at, kind (started, finished, reset).
    """
    resets = F.max(F.when(F.col("kind") == "reset", F.col("at"))).over(Window.partitionBy("loop"))
    live = events.withColumn("reset", resets).where("kind <> 'reset' and (reset is null or at > reset)")
    last = live.groupBy("loop", "role", "worker").agg(F.max_by("kind", F.struct("at", "kind")).alias("kind"), F.max("at").alias("at"))
    return last.where("kind = 'started'").drop("kind")


def replay(units: DataFrame, results: DataFrame) -> DataFrame:
    """unit_id and status of work units: replayed only if a result of the same semantic key succeeded; the newest epoch counts."""
    newest = results.groupBy("unit_id", "key").agg(F.max_by("status", "epoch").alias("status"), F.max_by("value", "epoch").alias("value"))
    joined = units.join(newest, ["unit_id", "key"], "left")
    done = F.col("status") == "succeeded"
    return joined.select("unit_id", F.coalesce(F.col("status"), F.lit("pending")).alias("status"), F.coalesce(done, F.lit(False)).alias("replayed"), F.when(done, F.col("value")).alias("value"))


def conflicts(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that stand for more than one value: the key and n values."""
    return rows.groupBy(*key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def lifecycle(loops: DataFrame) -> DataFrame:
    """loop_id and lifecycle from (rounds, max_rounds, failed, stopped, paused, active); the first that holds."""
    state = F.when(F.col("failed"), "failed").when(F.col("stopped") | (F.col("rounds") >= F.col("max_rounds")), "succeeded")
    state = state.when(F.col("paused"), "paused").when(F.col("active"), "running").when(F.col("rounds") > 0, "waiting").otherwise("pending")
    return loops.select("loop_id", state.alias("lifecycle"))


#: All lifecycles, in order.
LIFECYCLES = ("pending", "running", "waiting", "paused", "succeeded", "failed")


def lifecycle_counts(states: DataFrame) -> DataFrame:
    """lifecycle and n, with zeros."""
    names = states.sparkSession.createDataFrame([(x,) for x in LIFECYCLES], "lifecycle string")
    return names.join(states.groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n")), "lifecycle", "left").na.fill(0, ["n"])


def skipped(loops: DataFrame) -> DataFrame:
    """Loops of a fail-fast batch behind the first that failed: batch_id, ordinal."""
    first = F.min(F.when(F.col("failed"), F.col("ordinal"))).over(Window.partitionBy("batch_id"))
    return loops.withColumn("first", first).where("ordinal > first and not failed").select("batch_id", "ordinal")


def committed(turns: DataFrame, frontier: DataFrame) -> DataFrame:
    """Turns (loop_id, round) of rounds up to the loop's completed ones."""
    return turns.join(frontier, "loop_id").where("round <= rounds_completed").drop("rounds_completed")


def availability(usage: DataFrame) -> Column:
    """reported, partial or unavailable, from what counts are there."""
    known = lambda c: F.col(c).isNotNull()
    return F.when(known("input_tokens") & known("output_tokens"), "reported").when(known("input_tokens") | known("output_tokens") | known("cached_tokens"), "partial").otherwise("unavailable")


def cost(usage: DataFrame) -> Column:
    """Price of a row with rates (input_rate, output_rate, read_rate, write_rate per million); null if anything needed is unknown.

    Unknown isn't zero: a missing count, a missing rate of tokens that were used, or more cached tokens than input give null.
    """
    # twelve places are kept exactly: Spark would round the quotient of wide decimals
    each = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(14,6)") * F.lit("0.000001").cast("decimal(6,6)")
    ordinary = F.when(F.col("includes_cache"), F.col("input_tokens") - F.col("cached_tokens") - F.col("written_tokens")).when(~F.col("includes_cache"), F.col("input_tokens"))
    known = F.col("output_tokens").isNotNull() & F.col("cached_tokens").isNotNull() & F.col("written_tokens").isNotNull() & (ordinary >= 0)
    priced = ((F.col("cached_tokens") == 0) | F.col("read_rate").isNotNull()) & ((F.col("written_tokens") == 0) | F.col("write_rate").isNotNull())
    part = lambda n, r: n.cast("decimal(12,0)") * each(r)
    total = part(ordinary, "input_rate") + part(F.col("output_tokens"), "output_rate") + part(F.col("cached_tokens"), "read_rate") + part(F.col("written_tokens"), "write_rate")
    return F.when(known & priced, total.cast("decimal(38,12)"))


def cost_range(usage: DataFrame, long_input: int) -> DataFrame:
    """id, low and high over the cases that unknown cache inclusion leaves open.

    Above ``long_input`` tokens of input in all, input and cache cost twice and output one and a half times as much.
    """
    known = usage.where("input_tokens is not null and output_tokens is not null")
    filled = known.na.fill(0, ["cached_tokens", "written_tokens"])
    cases = F.when(F.col("includes_cache").isNotNull(), F.array("includes_cache")).otherwise(F.array(F.lit(True), F.lit(False)))
    each = filled.withColumn("includes_cache", F.explode(cases))
    whole = F.when(F.col("includes_cache"), F.col("input_tokens")).otherwise(F.col("input_tokens") + F.col("cached_tokens") + F.col("written_tokens"))
    long = whole > long_input
    for c in ("input_rate", "read_rate", "write_rate"):
        each = each.withColumn(c, F.col(c) * F.when(long, 2).otherwise(1))
    each = each.withColumn("output_rate", F.col("output_rate") * F.when(long, F.lit("1.5").cast("decimal(3,1)")).otherwise(F.lit("1.0").cast("decimal(3,1)")))
    return each.groupBy("id").agg(F.min(cost(each)).alias("low"), F.max(cost(each)).alias("high"))


def select_candidates(candidates: DataFrame) -> DataFrame:
    """task_id, ordinal and outcome of candidates (ordinal, valid, terminal): the only valid one, or of several the only terminal."""
    valid = candidates.where("valid")
    g = valid.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("terminal").alias("t"), F.min("ordinal").alias("only"), F.min(F.when(F.col("terminal"), F.col("ordinal"))).alias("last")
    )
    pick = F.when(F.col("n") == 1, F.col("only")).when(F.col("t") == 1, F.col("last"))
    tasks = candidates.select("task_id").distinct().join(g, "task_id", "left")
    outcome = F.when(F.col("n").isNull(), "none_valid").when(pick.isNotNull(), "selected").otherwise("conflict")
    return tasks.select("task_id", pick.alias("ordinal"), outcome.alias("outcome"))


def ordinal_errors(rows: DataFrame, group: str, ordinal: str, start: int) -> DataFrame:
    """Groups whose ordinals aren't start, start + 1, ... without gaps or repeats."""
    g = rows.groupBy(group).agg(F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct(ordinal).alias("d"))
    return g.where(f"lo <> {start} or hi <> lo + n - 1 or d <> n").select(group, "lo", "hi", "n")


def repeated_ids(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Rows whose parent doesn't exist."""
    return child.join(parent.select(on).distinct(), on, "left_anti")


def tiling_errors(spans: DataFrame, size: str = "size") -> DataFrame:
    """Spans (id, ordinal, start, stop) that don't begin where the one before ended; the first begins at 0, the last ends at ``size``."""
    w = Window.partitionBy("id").orderBy("ordinal")
    wrong = F.col("start") != F.coalesce(F.lag("stop").over(w), F.lit(0))
    short = F.lead("start").over(w).isNull() & (F.col("stop") != F.col(size))
    return spans.select("id", "ordinal", (wrong | short).alias("bad")).where("bad").drop("bad")
