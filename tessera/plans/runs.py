"""Queries on run records: a user's events stand for a run's log, conversations for loops of a batch, orders for work units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import runs as R
from tessera.plans.registry import query, table

SEQ = "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"


def numbered(spark, d):
    return R.numbered(table(spark, d, "events"), "user_id", ["ts", "event_id"])


@query("sk2_sequence_errors", f"""WITH {SEQ}, s AS (SELECT user_id AS run_id, sequence + CASE WHEN event_id % 50 = 0 THEN 1000 ELSE 0 END AS sequence FROM n), p AS (SELECT *, lag(sequence) OVER (PARTITION BY run_id ORDER BY sequence) AS p FROM s)
SELECT run_id, sequence, CASE WHEN p IS NULL THEN 'first_not_one' ELSE 'not_contiguous' END AS rule FROM p WHERE (p IS NULL AND sequence <> 1) OR sequence <> p + 1""")
def sk2_sequence_errors(spark, d):
    gap = F.when(F.col("event_id") % 50 == 0, 1000).otherwise(0)
    return R.sequence_errors(numbered(spark, d).select(F.col("user_id").alias("run_id"), (F.col("sequence") + gap).alias("sequence")))


@query("sk1_event_ids", f"""WITH {SEQ} SELECT event_id AS id, sha256('{{"data":' || props || ',"event":"' || event_type || '","run_id":"' || user_id || '","sequence":' || sequence || '}}') AS event_id FROM n""")
def sk1_event_ids(spark, d):
    rows = numbered(spark, d).select(F.col("event_id").alias("id"), F.col("props").alias("data"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("run_id"), "sequence")
    return R.event_ids(rows).select("id", "event_id")


STATUS = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END"
ALLOWED = " OR ".join(f"(ps = '{a}' AND status = '{b}')" for a, b in R.TRANSITIONS)


@query("sk3_transition_errors", f"""WITH {SEQ}, s AS (SELECT user_id AS run_id, sequence, {STATUS} AS status, sequence % 3 AS attempt, sequence % 2 AS epoch FROM n),
p AS (SELECT *, lag(status) OVER w AS ps, lag(attempt) OVER w AS pa, lag(epoch) OVER w AS pe FROM s WINDOW w AS (PARTITION BY run_id ORDER BY sequence)),
r AS (SELECT run_id, sequence, CASE WHEN ps IS NULL AND status <> 'created' THEN 'first_not_created' WHEN ps <> status AND NOT ({ALLOWED}) THEN 'transition'
  WHEN attempt <> pa + CASE WHEN ps <> status AND status = 'running' THEN 1 ELSE 0 END THEN 'attempt'
  WHEN epoch <> pe + CASE WHEN ps = 'failed' AND status = 'running' THEN 1 ELSE 0 END THEN 'epoch' END AS rule FROM p)
SELECT * FROM r WHERE rule IS NOT NULL""")
def sk3_transition_errors(spark, d):
    status = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "paused").when(F.col("event_type") == "purchase", "succeeded").otherwise("failed")
    rows = numbered(spark, d).select(F.col("user_id").alias("run_id"), "sequence", status.alias("status"), (F.col("sequence") % 3).alias("attempt"), (F.col("sequence") % 2).alias("epoch"))
    return R.transition_errors(rows)


@query("sk4_interrupted", "SELECT o_orderkey AS run_id, 'paused' AS status, 'execution_interrupted' AS reason FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def sk4_interrupted(spark, d):
    o = table(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded").alias("status"))
    leases = o.join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("run_id"))
    return R.interrupted(runs, leases)


@query("sk8_first_stops", "SELECT user_id AS run_id, event_id % 3 AS attempt, arg_min(event_type, (ts, event_type)) AS reason FROM events GROUP BY 1, 2")
def sk8_first_stops(spark, d):
    e = table(spark, d, "events")
    return R.first_stops(e.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 3).alias("attempt"), F.col("ts").alias("at"), F.col("event_type").alias("reason")))


ACT = """a AS (SELECT user_id % 20 AS loop, CASE WHEN user_id % 2 = 0 THEN 'proposer' ELSE 'reviewer' END AS role, user_id AS worker, event_id AS "at",
CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'finished' WHEN 'click' THEN 'finished' ELSE CASE WHEN event_id % 97 = 0 THEN 'reset' ELSE 'started' END END AS kind FROM events)"""


def activity(spark, d):
    t = F.col("event_type")
    kind = F.when(t.isin("signup", "view"), "started").when(t.isin("purchase", "click"), "finished").when(F.col("event_id") % 97 == 0, "reset").otherwise("started")
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("loop"), F.when(F.col("user_id") % 2 == 0, "proposer").otherwise("reviewer").alias("role"), F.col("user_id").alias("worker"), F.col("event_id").alias("at"), kind.alias("kind"))


@query("sk5_last_activity", f"""WITH {ACT}, r AS (SELECT loop, max("at") AS reset FROM a WHERE kind = 'reset' GROUP BY loop), l AS (SELECT a.*, row_number() OVER (PARTITION BY a.loop, role, worker ORDER BY "at" DESC) AS n FROM a LEFT JOIN r USING (loop) WHERE kind <> 'reset' AND (reset IS NULL OR "at" > reset))
SELECT loop, role, worker, "at" FROM l WHERE n = 1 AND kind = 'started'""")
def sk5_last_activity(spark, d):
    return R.last_activity(activity(spark, d))


@query("sk10_work_group", """WITH u AS (SELECT o_orderkey AS unit_id, o_custkey % 5 AS key FROM orders), r AS (SELECT l_orderkey AS unit_id, l_partkey % 5 AS key, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS status, l_linenumber * 100000 + l_suppkey AS value, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 7 AS epoch FROM lineitem),
n AS (SELECT unit_id, key, arg_max(status, epoch) AS status, arg_max(value, epoch) AS value FROM (SELECT unit_id, key, epoch, max(status) AS status, max(value) AS value FROM r GROUP BY ALL) GROUP BY 1, 2)
SELECT unit_id, coalesce(status, 'pending') AS status, coalesce(status = 'succeeded', false) AS replayed, CASE WHEN status = 'succeeded' THEN value END AS value FROM u LEFT JOIN n USING (unit_id, key)""")
def sk10_work_group(spark, d):
    units = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 5).alias("key"))
    r = table(spark, d, "lineitem")
    results = r.select(F.col("l_orderkey").alias("unit_id"), (F.col("l_partkey") % 5).alias("key"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("status"),
        (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("value"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 7).alias("epoch"))
    results = results.groupBy("unit_id", "key", "epoch").agg(F.max("status").alias("status"), F.max("value").alias("value"))
    return R.replay(units, results)


@query("j16_semantic_key_replay", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS k, bool_or(l_returnflag = 'N') AS ok FROM lineitem GROUP BY ALL), n AS (SELECT l_orderkey, k, arg_max(ok, l_linenumber) AS ok FROM (SELECT l_orderkey, k, l_linenumber, bool_or(ok) AS ok FROM r GROUP BY ALL) GROUP BY ALL)
SELECT o_orderkey AS unit_id FROM orders JOIN n ON l_orderkey = o_orderkey AND k = o_custkey % 4 WHERE ok""")
def j16_semantic_key_replay(spark, d):
    units = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 4).alias("key"))
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id"), (F.col("l_partkey") % 4).alias("key"), F.col("l_linenumber").alias("epoch")).agg(F.bool_or(F.col("l_returnflag") == "N").alias("ok"))
    done = R.replay(units, r.select("*", F.when(F.col("ok"), "succeeded").otherwise("failed").alias("status"), F.lit(1).alias("value")))
    return done.where("replayed").select("unit_id")


@query("sk18_resume_conflicts", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def sk18_resume_conflicts(spark, d):
    return R.conflicts(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("sk24_request_conflicts", "SELECT user_id, event_type, count(DISTINCT props) AS n FROM events GROUP BY ALL HAVING count(DISTINCT props) > 1")
def sk24_request_conflicts(spark, d):
    return R.conflicts(table(spark, d, "events"), ["user_id", "event_type"], "props")


@query("sc17_artifact_conflicts", "SELECT p_brand, p_type, count(DISTINCT p_size) AS n FROM part GROUP BY ALL HAVING count(DISTINCT p_size) > 1")
def sc17_artifact_conflicts(spark, d):
    return R.conflicts(table(spark, d, "part"), ["p_brand", "p_type"], "p_size")


LOOPS = """g AS (SELECT conv_id AS loop_id, max(turn) // 2 AS rounds, 3 + conv_id % 3 AS max_rounds, conv_id % 11 = 0 AS failed, conv_id % 13 = 0 AS stopped, conv_id % 7 = 0 AS paused, conv_id % 3 = 0 AS active FROM conversations GROUP BY conv_id),
s AS (SELECT loop_id, CASE WHEN failed THEN 'failed' WHEN stopped OR rounds >= max_rounds THEN 'succeeded' WHEN paused THEN 'paused' WHEN active THEN 'running' WHEN rounds > 0 THEN 'waiting' ELSE 'pending' END AS lifecycle FROM g)"""


def loops(spark, d):
    g = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("loop_id")).agg(F.max("turn").alias("t"))
    m = lambda k: F.col("loop_id") % k == 0
    return g.select("loop_id", F.expr("t div 2").alias("rounds"), (3 + F.col("loop_id") % 3).alias("max_rounds"), m(11).alias("failed"), m(13).alias("stopped"), m(7).alias("paused"), m(3).alias("active"))


@query("sk14_lifecycle", f"WITH {LOOPS} SELECT * FROM s")
def sk14_lifecycle(spark, d):
    return R.lifecycle(loops(spark, d))


@query("a5_lifecycle_counts", f"WITH {LOOPS} SELECT lifecycle, count(loop_id) AS n FROM (VALUES ('pending'), ('running'), ('waiting'), ('paused'), ('succeeded'), ('failed')) v(lifecycle) LEFT JOIN s USING (lifecycle) GROUP BY lifecycle")
def a5_lifecycle_counts(spark, d):
    return R.lifecycle_counts(R.lifecycle(loops(spark, d)))


@query("sk21_failfast_skipped", f"WITH {LOOPS}, f AS (SELECT loop_id % 4 AS batch_id, loop_id AS ordinal, failed, min(CASE WHEN failed THEN loop_id END) OVER (PARTITION BY loop_id % 4) AS first FROM g) SELECT batch_id, ordinal FROM f WHERE ordinal > first AND NOT failed")
def sk21_failfast_skipped(spark, d):
    return R.skipped(loops(spark, d).select((F.col("loop_id") % 4).alias("batch_id"), F.col("loop_id").alias("ordinal"), "failed"))


@query("sk15_committed_turns", f"WITH {LOOPS} SELECT conv_id AS loop_id, turn, turn // 2 + 1 AS round FROM conversations JOIN g ON loop_id = conv_id WHERE turn // 2 + 1 <= rounds")
def sk15_committed_turns(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("loop_id"), "turn", F.expr("turn div 2 + 1").alias("round"))
    return R.committed(turns, loops(spark, d).select("loop_id", F.col("rounds").alias("rounds_completed")))


@query("sk13_rounds", "SELECT conv_id AS loop_id, turn // 2 AS round, count(*) AS turns, count(*) FILTER (role = 'assistant') AS proposals, bool_and(text <> '') AS complete FROM conversations GROUP BY ALL")
def sk13_rounds(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy(F.col("conv_id").alias("loop_id"), F.expr("turn div 2").alias("round")).agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("proposals"), F.bool_and(F.col("text") != "").alias("complete"))


@query("a6_activity_counts", "SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS pending, count(*) FILTER (event_type IN ('signup', 'purchase')) AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id")
def a6_activity_counts(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(t.isin("view", "click")).alias("pending"), F.count_if(t.isin("signup", "purchase")).alias("succeeded"), F.count_if(t == "error").alias("failed"))


USE = """u AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 7 <> 6 THEN length(text) END AS input_tokens, CASE WHEN turn % 5 <> 4 THEN length(text) // 2 END AS output_tokens,
CASE WHEN turn % 4 <> 3 THEN length(text) // (1 + turn % 3) END AS cached_tokens, CASE WHEN conv_id % 3 <> 2 THEN turn * 10 ELSE 0 END AS written_tokens, CASE conv_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS includes_cache,
2.5::DECIMAL(18,6) AS input_rate, 10::DECIMAL(18,6) AS output_rate, CASE WHEN conv_id % 5 <> 0 THEN 0.25::DECIMAL(18,6) END AS read_rate, 3.125::DECIMAL(18,6) AS write_rate FROM conversations)"""
PRICE = """CASE WHEN output_tokens IS NOT NULL AND cached_tokens IS NOT NULL AND written_tokens IS NOT NULL AND ordinary >= 0 AND (cached_tokens = 0 OR read_rate IS NOT NULL) AND (written_tokens = 0 OR write_rate IS NOT NULL)
THEN ((ordinary::DECIMAL(18,0) * input_rate + output_tokens::DECIMAL(18,0) * output_rate + cached_tokens::DECIMAL(18,0) * coalesce(read_rate, 0) + written_tokens::DECIMAL(18,0) * coalesce(write_rate, 0)))::DECIMAL(38,6) END"""


def usage(spark, d):
    c, k = table(spark, d, "conversations"), F.col("conv_id")
    n, t = F.length("text"), F.col("turn")
    rate = lambda v: F.lit(v).cast("decimal(18,6)")
    return c.select(
        (k * 100 + t).alias("id"), F.when(t % 7 != 6, n).alias("input_tokens"), F.when(t % 5 != 4, F.expr("length(text) div 2")).alias("output_tokens"),
        F.when(t % 4 != 3, F.expr("length(text) div (1 + turn % 3)")).alias("cached_tokens"), F.when(k % 3 != 2, t * 10).otherwise(0).alias("written_tokens"),
        F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("includes_cache"), rate("2.5").alias("input_rate"), rate("10").alias("output_rate"),
        F.when(k % 5 != 0, rate("0.25")).alias("read_rate"), rate("3.125").alias("write_rate"),
    )


def _millionths(amount):
    return (amount.cast("decimal(28,12)") * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,6)")


@query("a12_usage_availability", f"WITH {USE} SELECT id, CASE WHEN input_tokens IS NOT NULL AND output_tokens IS NOT NULL THEN 'reported' WHEN coalesce(input_tokens, output_tokens, cached_tokens) IS NOT NULL THEN 'partial' ELSE 'unavailable' END AS availability FROM u")
def a12_usage_availability(spark, d):
    u = usage(spark, d)
    return u.select("id", R.availability(u).alias("availability"))


@query("a13_cost", f"WITH {USE}, o AS (SELECT *, CASE WHEN includes_cache THEN input_tokens - cached_tokens - written_tokens WHEN NOT includes_cache THEN input_tokens END AS ordinary FROM u) SELECT id, {PRICE} AS millionths FROM o")
def a13_cost(spark, d):
    u = usage(spark, d)
    return u.select("id", _millionths(R.cost(u)).alias("millionths"))


@query("a14_cost_range", f"""WITH {USE}, k AS (SELECT * REPLACE (coalesce(cached_tokens, 0) AS cached_tokens, coalesce(written_tokens, 0) AS written_tokens) FROM u WHERE input_tokens IS NOT NULL AND output_tokens IS NOT NULL),
c AS (SELECT * REPLACE (v AS includes_cache) FROM (SELECT *, unnest(CASE WHEN includes_cache IS NULL THEN [true, false] ELSE [includes_cache] END) AS v FROM k)),
l AS (SELECT * EXCLUDE (v), CASE WHEN includes_cache THEN input_tokens - cached_tokens - written_tokens ELSE input_tokens END AS ordinary, CASE WHEN includes_cache THEN input_tokens ELSE input_tokens + cached_tokens + written_tokens END > 600 AS long FROM c),
r AS (SELECT * REPLACE ((input_rate * CASE WHEN long THEN 2 ELSE 1 END)::DECIMAL(18,6) AS input_rate, (output_rate * CASE WHEN long THEN 1.5 ELSE 1 END)::DECIMAL(18,6) AS output_rate, (read_rate * CASE WHEN long THEN 2 ELSE 1 END)::DECIMAL(18,6) AS read_rate, (write_rate * CASE WHEN long THEN 2 ELSE 1 END)::DECIMAL(18,6) AS write_rate) FROM l)
SELECT id, min({PRICE}) AS low_millionths, max({PRICE}) AS high_millionths FROM r GROUP BY id""")
def a14_cost_range(spark, d):
    r = R.cost_range(usage(spark, d), 600)
    return r.select("id", _millionths(F.col("low")).alias("low_millionths"), _millionths(F.col("high")).alias("high_millionths"))


CAND = "c AS (SELECT l_orderkey AS task_id, l_linenumber AS ordinal, bool_or(l_returnflag = 'N') AS valid, bool_or(l_linestatus = 'F') AS terminal FROM lineitem GROUP BY ALL)"


@query("sx11_candidates", f"""WITH {CAND}, g AS (SELECT task_id, count(*) AS n, count(*) FILTER (terminal) AS t, min(ordinal) AS sole, min(ordinal) FILTER (terminal) AS last FROM c WHERE valid GROUP BY task_id),
p AS (SELECT task_id, n, CASE WHEN n = 1 THEN sole WHEN t = 1 THEN last END AS ordinal FROM (SELECT DISTINCT task_id FROM c) LEFT JOIN g USING (task_id))
SELECT task_id, ordinal, CASE WHEN n IS NULL THEN 'none_valid' WHEN ordinal IS NOT NULL THEN 'selected' ELSE 'conflict' END AS outcome FROM p""")
def sx11_candidates(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("ordinal")).agg(F.bool_or(F.col("l_returnflag") == "N").alias("valid"), F.bool_or(F.col("l_linestatus") == "F").alias("terminal"))
    return R.select_candidates(c)


@query("sx13_formatting_source", f"WITH {CAND} SELECT task_id, CASE WHEN count(*) FILTER (terminal) = 1 THEN min(ordinal) FILTER (terminal) WHEN count(*) = 1 THEN min(ordinal) END AS ordinal FROM c GROUP BY task_id")
def sx13_formatting_source(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("ordinal")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("terminal"))
    g = c.groupBy("task_id").agg(F.count_if("terminal").alias("t"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("terminal"), F.col("ordinal"))).alias("last"), F.min("ordinal").alias("only"))
    return g.select("task_id", F.when(F.col("t") == 1, F.col("last")).when(F.col("n") == 1, F.col("only")).alias("ordinal"))


@query("sx14_provider_events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'purchase' THEN CAST(json_extract(props, '$.k') AS BIGINT) + 1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS tokens FROM events")
def sx14_provider_events(spark, d):
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.select("event_id", "k", F.when(F.col("event_type") == "purchase", F.col("k") + 1).otherwise(F.col("k")).alias("tokens"))


@query("sc16_event_tail", """WITH t AS (SELECT event_id, octet_length(encode(props)) + 1 AS b FROM events), s AS (SELECT *, sum(b) OVER (ORDER BY event_id DESC) AS after FROM t) SELECT event_id FROM s WHERE after <= 4096""")
def sc16_event_tail(spark, d):
    from tessera.sources.logs import tail

    return tail(table(spark, d, "events").select("event_id", F.col("props").alias("line")), "event_id", 4096).select("event_id")


@query("sk20_snapshot_projection", f"SELECT event_id, {STATUS} AS status, {STATUS} <> 'succeeded' AS can_resume FROM events")
def sk20_snapshot_projection(spark, d):
    t = F.col("event_type")
    status = F.when(t == "signup", "created").when(t == "view", "running").when(t == "click", "paused").when(t == "purchase", "succeeded").otherwise("failed")
    return table(spark, d, "events").select("event_id", status.alias("status"), (status != "succeeded").alias("can_resume"))


@query("sk22_failed_loops", "SELECT user_id AS loop_id, string_agg(event_id, ',' ORDER BY event_id) AS failed FROM events WHERE event_type = 'error' GROUP BY user_id")
def sk22_failed_loops(spark, d):
    g = table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("loop_id")).agg(F.array_sort(F.collect_list("event_id")).alias("f"))
    return g.select("loop_id", F.array_join("f", ",").alias("failed"))


@query("w17_revisions", f"WITH {SEQ} SELECT user_id, sequence FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY sequence) AS p FROM n) WHERE p = event_type")
def w17_revisions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("sequence")
    return numbered(spark, d).withColumn("p", F.lag("event_type").over(w)).where("p = event_type").select("user_id", "sequence")


@query("v1_ordinals", "SELECT conv_id, min(turn) AS lo, max(turn) AS hi, count(*) AS n FROM conversations WHERE (conv_id + turn) % 23 <> 0 GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) <> min(turn) + count(*) - 1 OR count(DISTINCT turn) <> count(*)")
def v1_ordinals(spark, d):
    return R.ordinal_errors(table(spark, d, "conversations").where("(conv_id + turn) % 23 <> 0"), "conv_id", "turn", 0)


@query("v2_repeated_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def v2_repeated_ids(spark, d):
    return R.repeated_ids(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v3_orphans", "SELECT doc_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents WHERE documents.doc_id = labels.doc_id AND documents.lang = 'en')")
def v3_orphans(spark, d):
    return R.orphans(table(spark, d, "labels"), table(spark, d, "documents").where("lang = 'en'"), "doc_id").select("doc_id")


@query("v4_tiling", """WITH s AS (SELECT conv_id AS id, turn AS ordinal, length(text) AS len, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN turn = 4 THEN 1 ELSE 0 END AS start, sum(length(text)) OVER (PARTITION BY conv_id) AS size FROM conversations),
p AS (SELECT *, start + len AS stop, lag(start + len) OVER w AS p, lead(start) OVER w AS n FROM s WINDOW w AS (PARTITION BY id ORDER BY ordinal)) SELECT id, ordinal FROM p WHERE start <> coalesce(p, 0) OR (n IS NULL AND stop <> size)""")
def v4_tiling(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)) + F.when(F.col("turn") == 4, 1).otherwise(0)
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("ordinal"), start.alias("start"), (start + F.length("text")).alias("stop"), F.sum(F.length("text")).over(Window.partitionBy("conv_id")).alias("size"))
    return R.tiling_errors(rows)


@query("sk19_run_report", f"""WITH {SEQ} SELECT 'sequence' AS check, user_id AS run_id, count(*) AS n FROM n WHERE sequence % 40 = 0 GROUP BY ALL UNION ALL SELECT 'value', user_id, count(*) FROM events WHERE value < 1 GROUP BY ALL""")
def sk19_run_report(spark, d):
    a = numbered(spark, d).where("sequence % 40 = 0").groupBy(F.lit("sequence").alias("check"), F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "events").where("value < 1").groupBy(F.lit("value").alias("check"), F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)
