"""Queries whose operators depend on order within a group; their rows are tested against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.arrow import json_digest, normalize_term, normalize_tex, reduced_ratio
from tessera.operators import blocks, folds
from tessera.plans.registry import query, table
from tessera.sources import containers


@query("sk6_circuit_breaker")
def sk6_circuit_breaker(spark, d):
    e = table(spark, d, "events")
    outcome = F.when(F.col("event_type") == "error", "transport").when((F.col("event_type") == "click") & (F.col("event_id") % 40 == 0), "rate_limit").otherwise("success")
    calls = e.select((F.col("user_id") % 25).cast("string").alias("provider"), F.unix_timestamp("ts").cast("double").alias("at"), F.col("event_id").alias("ordinal"), outcome.alias("outcome"), F.when(F.col("event_id") % 80 == 0, 60.0).alias("retry_after"), F.lit(None).cast("int").alias("epoch"))
    return folds.circuit_states(calls)


@query("sk17_prefix_chain")
def sk17_prefix_chain(spark, d):
    c = table(spark, d, "conversations")
    return folds.prefix_chain(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")))


@query("a20_bundle_budget")
def a20_bundle_budget(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("bundle"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), (F.col("l_partkey") % 50).cast("string").alias("digest"), F.col("l_quantity").cast("long").alias("size"))
    return folds.admitted(i, 45, 500, 30)


@query("j1_reconcile")
def j1_reconcile(spark, d):
    c = table(spark, d, "conversations")
    spans = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.col("role").alias("kind"), F.col("text").alias("tex"), F.lit("").alias("label"), F.lit("").alias("context"))
    return folds.reconcile(spans, spans.where("(doc_id + ordinal) % 4 <> 0"))


@query("w16_outline_alignment")
def w16_outline_alignment(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.col("text").alias("title"))
    return folds.aligned(c, c.where("ordinal % 3 <> 1"))


@query("sx8_json_candidates")
def sx8_json_candidates(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit('found "{no" and '), "props", F.lit(" then [1, 2]"))
    return folds.json_candidates(e.select(F.col("event_id").alias("id"), text.alias("text")), {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}})


@query("sx10_invented_numbers")
def sx10_invented_numbers(spark, d):
    e = table(spark, d, "events")
    return folds.fabricated(e.select(F.col("event_id").alias("id"), F.col("props").alias("value"), F.concat(F.lit("about "), F.col("event_id").cast("string")).alias("source")))


@query("sx7_canonical_digest")
def sx7_canonical_digest(spark, d):
    return table(spark, d, "events").select("event_id", json_digest("props").alias("digest"))


@query("st2_normalized_terms")
def st2_normalized_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", normalize_term("text").alias("term"))


@query("st8_normalized_tex")
def st8_normalized_tex(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize_tex("text").alias("tex"))


@query("sx3_reduced_ratio", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS w, (l_partkey % 60)::BIGINT AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN w > 0 AND h > 0 THEN (w // gcd(w, h)) || ':' || (h // gcd(w, h)) END AS ratio FROM r""")
def sx3_reduced_ratio(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reduced_ratio(F.col("l_quantity").cast("long"), (F.col("l_partkey") % 60).cast("long")).alias("ratio"))


@query("w14_equation_rows", """WITH r AS (SELECT user_id AS doc_id, event_id AS "row", CASE WHEN event_type = 'purchase' THEN 't' END AS tag FROM events),
n AS (SELECT doc_id, "row", last_value(CASE WHEN tag IS NOT NULL THEN "row" END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS b, first_value(CASE WHEN tag IS NOT NULL THEN "row" END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY "row"))
SELECT doc_id, "row", CASE WHEN b IS NULL THEN a WHEN a IS NULL OR "row" - b <= a - "row" THEN b ELSE a END AS "group" FROM n""")
def w14_equation_rows(spark, d):
    e = table(spark, d, "events")
    return blocks.equation_rows(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("row"), F.when(F.col("event_type") == "purchase", "t").alias("tag")))


@query("a10_distinct_candidates", "SELECT conv_id AS task_id, sha256(text) AS digest, min(turn) AS ordinal, bool_or(role = 'assistant') AS terminal FROM conversations GROUP BY ALL")
def a10_distinct_candidates(spark, d):
    c = table(spark, d, "conversations")
    return blocks.distinct_candidates(c.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("ordinal"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (F.col("role") == "assistant").alias("terminal")))


@query("a7_visible_content", "SELECT user_id AS doc_id, count(*) FILTER (event_type = 'view') AS emitted, count(*) FILTER (event_type = 'click') AS excluded, count(*) FILTER (event_type = 'signup') AS opaque, count(*) FILTER (event_type NOT IN ('view', 'click', 'signup')) AS unaccounted FROM events GROUP BY user_id")
def a7_visible_content(spark, d):
    t = F.col("event_type")
    disposition = F.when(t == "view", "emitted").when(t == "click", "excluded").when(t == "signup", "opaque")
    return blocks.visible_content(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), disposition.alias("disposition")))


@query("sk7_provider_streams")
def sk7_provider_streams(spark, d):
    c = table(spark, d, "conversations")
    line = F.to_json(F.struct(F.when(F.col("role") == "assistant", "result").otherwise("text").alias("type"), "text"))
    data = F.concat(line, F.lit("\n"), F.when(F.col("turn") == 1, '{"type": "completed"}\n').otherwise(""))
    return containers.accumulated(c.select(F.col("conv_id").alias("task_id"), F.col("turn").cast("int").alias("chunk_index"), data.cast("binary").alias("data")))


@query("sc9_outlines")
def sc9_outlines(spark, d):
    c = table(spark, d, "conversations")
    node = F.struct(F.col("turn").alias("page"), F.col("text").alias("title"))
    g = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.to_json(F.array_sort(F.collect_list(node))).alias("outline"))
    return containers.outlines(g)
