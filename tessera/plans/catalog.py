"""Queries on stores, catalogs, sets and small decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.plans.registry import query, table
from tessera.sources import catalog as C


def payloads(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.col("lang").alias("format"), F.col("source").alias("media_type"), F.col("text").cast("binary").alias("payload"))


@query("sc2_store", "SELECT lang AS format, sha256(text) AS digest, min(octet_length(encode(text))) AS size, min(source) AS media_type FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def sc2_store(spark, d):
    return C.store(payloads(spark, d))


@query("sc2_store_conflicts", "SELECT lang AS format, sha256(text) AS digest, count(DISTINCT source) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source) > 1")
def sc2_store_conflicts(spark, d):
    return C.store_conflicts(payloads(spark, d))


@query("sc3_verified_read", """WITH m AS (SELECT doc_id AS key, CASE WHEN doc_id % 10 = 0 THEN 'bad' WHEN doc_id % 10 = 1 THEN sha256('x') ELSE sha256(text) END AS digest FROM documents WHERE text IS NOT NULL)
SELECT key, CASE WHEN digest = 'bad' THEN 'source_manifest_invalid' WHEN key % 10 = 2 THEN 'source_not_found' WHEN key % 10 = 1 THEN 'source_corrupt' END AS error FROM m""")
def sc3_verified_read(spark, d):
    rows = payloads(spark, d).withColumnRenamed("doc_id", "key")
    k = F.col("key") % 10
    digest = F.when(k == 0, "bad").when(k == 1, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.sha2("payload", 256))
    return C.verify(rows.select("key", digest.alias("digest"), F.octet_length("payload").cast("long").alias("size")), rows.where("key % 10 <> 2").select("key", "payload"))


@query("sc5_assets", "SELECT sha256(html) AS digest, count(*) AS n, min(octet_length(encode(html))) AS size FROM pages GROUP BY ALL")
def sc5_assets(spark, d):
    p = table(spark, d, "pages")
    return p.groupBy(F.sha2(F.col("html").cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(F.octet_length("html")).alias("size"))


@query("sc6_to_parse", "SELECT doc_id AS digest FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)")
def sc6_to_parse(spark, d):
    cache = table(spark, d, "labels").select(F.col("doc_id").alias("digest"), F.when(F.col("quality") == 1, "v1").otherwise("v0").alias("parser_contract"))
    return C.to_parse(table(spark, d, "documents").select(F.col("doc_id").alias("digest")), cache, "v1")


@query("sc7_catalog", """WITH r AS (SELECT source AS locator, lang AS format, doc_id AS digest, n_chars AS "at", doc_id % 3 AS document_id FROM documents), l AS (SELECT *, row_number() OVER (PARTITION BY locator, format ORDER BY "at" DESC, digest DESC) AS r FROM r),
i AS (SELECT locator, format, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS document_ids FROM r GROUP BY ALL) SELECT locator, format, digest, "at", document_ids FROM l JOIN i USING (locator, format) WHERE r = 1""")
def sc7_catalog(spark, d):
    r = table(spark, d, "documents").select(F.col("source").alias("locator"), F.col("lang").alias("format"), F.col("doc_id").alias("digest"), F.col("n_chars").alias("at"), (F.col("doc_id") % 3).alias("document_id"))
    return C.catalog(r).withColumn("document_ids", F.array_join("document_ids", ","))


@query("sc14_bundle", """SELECT p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 7 = 1 THEN 'unlisted' ELSE 'changed' END AS what FROM part WHERE p_partkey % 7 IN (0, 1) OR p_partkey % 7 = 2""")
def sc14_bundle(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.md5(F.col("p_name").cast("binary")).alias("digest"))
    files = p.where("path % 7 <> 0").withColumn("digest", F.when(F.col("path") % 7 == 2, "x").otherwise(F.col("digest")))
    return C.bundle_differences(p.where("path % 7 <> 1"), files)


@query("sc18_working_state", "SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(c_name, s_name) AS digest, c_name IS NOT NULL AS edited FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) FULL JOIN supplier ON c_custkey = s_suppkey")
def sc18_working_state(spark, d):
    w = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("digest"))
    return C.working_state(w, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("digest")))


@query("sc20_removal", "SELECT doc_id AS entry_id, NOT (doc_id IN (5, 9) OR source IN ('src1', 'src2')) AS stays FROM documents")
def sc20_removal(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), F.col("source").alias("document_id"))
    gone, left = C.removal(e, ["src1", "src2"], [5, 9])
    return gone.select("entry_id", F.lit(False).alias("stays")).unionByName(left.select("entry_id", F.lit(True).alias("stays")))


@query("sc21_cache_status", """SELECT d.doc_id AS key, CASE WHEN l.doc_id IS NULL THEN 'miss' WHEN l.quality <> d.doc_id % 2 THEN 'contract' WHEN l.toxic <> 0 THEN 'source' WHEN d.doc_id % 5 = 0 THEN 'document' ELSE 'hit' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def sc21_cache_status(spark, d):
    r = table(spark, d, "documents").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 2).alias("contract"), F.lit(0).alias("source"), F.lit(1).alias("document"))
    c = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("contract"), F.col("toxic").alias("source"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("document"))
    return C.verified_read(r, c)


@query("sc22_structure_cache", "SELECT i.p_partkey AS key, c.s_name AS content FROM part i JOIN supplier c ON c.s_suppkey = i.p_size")
def sc22_structure_cache(spark, d):
    i = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("digest"))
    return i.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("digest"), F.col("s_name").alias("content")), "digest").select("key", "content")


@query("sc24_index_changes", "SELECT coalesce(a, b) AS path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT o_orderkey AS a, o_orderstatus AS x FROM orders WHERE o_orderkey % 5 <> 0) FULL JOIN (SELECT o_orderkey AS b, CASE WHEN o_orderkey % 6 = 0 THEN 'new' ELSE o_orderstatus END AS y FROM orders WHERE o_orderkey % 7 <> 0) ON a = b WHERE a IS NULL OR b IS NULL OR x <> y")
def sc24_index_changes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("hash"))
    return C.changes(o.where("path % 5 <> 0"), o.where("path % 7 <> 0").withColumn("hash", F.when(F.col("path") % 6 == 0, "new").otherwise(F.col("hash"))))


@query("j15_catalog_merge", """WITH e AS (SELECT lang AS format, sha256(text) AS digest, CASE WHEN doc_id % 4 <> 0 THEN source END AS document_id FROM documents WHERE text IS NOT NULL)
SELECT format, digest, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS document_ids, count(*) AS entries FROM e WHERE document_id IS NOT NULL GROUP BY ALL UNION ALL SELECT format, digest, '', 1 FROM e WHERE document_id IS NULL""")
def j15_catalog_merge(spark, d):
    return C.merged(payloads(spark, d).select("format", F.sha2("payload", 256).alias("digest"), F.when(F.col("doc_id") % 4 != 0, F.col("media_type")).alias("document_id")))


@query("a9_components", "SELECT user_id AS entry_id, event_type AS component, max(event_id) AS cached_at, string_agg(DISTINCT event_id % 7, ',' ORDER BY event_id % 7) AS document_ids FROM events GROUP BY ALL")
def a9_components(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entry_id"), F.col("event_type").alias("component"), F.col("event_id").alias("cached_at"), (F.col("event_id") % 7).alias("document_id"))
    return C.components(e)


CACHE = "e AS (SELECT doc_id AS entry_id, n_chars AS cached_at, doc_id % 2 AS identified, [lang, source] AS document_ids FROM documents)"


@query("pf5_cache_list", f"WITH {CACHE} SELECT entry_id, cached_at FROM e WHERE (list_has_any(document_ids, ['de', 'src3']) OR entry_id IN (4, 6)) AND cached_at >= 500")
def pf5_cache_list(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), F.col("n_chars").alias("cached_at"), (F.col("doc_id") % 2).alias("identified"), F.array("lang", "source").alias("document_ids"))
    return C.listing(e, ["de", "src3"], [4, 6], 500).select("entry_id", "cached_at")


@query("l7_cache_order", f"WITH {CACHE}, r AS (SELECT entry_id, row_number() OVER (ORDER BY cached_at DESC, identified DESC, entry_id) AS place FROM e) SELECT * FROM r WHERE place <= 50")
def l7_cache_order(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), F.col("n_chars").alias("cached_at"), (F.col("doc_id") % 2).alias("identified"), F.array("lang", "source").alias("document_ids"))
    first = C.listing(e, [], [], -1).limit(50)
    return first.select("entry_id", F.row_number().over(Window.orderBy(F.desc("cached_at"), F.desc("identified"), "entry_id")).alias("place"))


@query("pf6_preferred", """WITH r AS (SELECT l_orderkey AS entry_id, l_linenumber AS ordinal, min(CASE WHEN l_partkey % 3 = 0 THEN 'html' WHEN l_partkey % 3 = 1 THEN 'pdf' ELSE 'tex' END) AS format, min(l_returnflag) AS contract FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY CASE format WHEN 'html' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END, ordinal) AS r FROM r WHERE contract = 'N') SELECT entry_id, ordinal, format FROM k WHERE r = 1""")
def pf6_preferred(spark, d):
    f = F.when(F.col("l_partkey") % 3 == 0, "html").when(F.col("l_partkey") % 3 == 1, "pdf").otherwise("tex")
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entry_id"), F.col("l_linenumber").alias("ordinal")).agg(F.min(f).alias("format"), F.min("l_returnflag").alias("contract"))
    return C.preferred(r, "N").select("entry_id", "ordinal", "format")


@query("pf7_effect_filter", "SELECT p_partkey FROM part WHERE NOT list_has_any(string_split(lower(p_type), ' '), ['brass', 'tin', 'promo'])")
def pf7_effect_filter(spark, d):
    flags = F.split(F.lower("p_type"), " ")
    return table(spark, d, "part").where(~F.arrays_overlap(flags, F.array(F.lit("brass"), F.lit("tin"), F.lit("promo")))).select("p_partkey")


@query("pf11_fatal_entries", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality = 0 ELSE toxic = 1 END AS fatal FROM labels")
def pf11_fatal_entries(spark, d):
    section = F.col("doc_id") % 2 == 0
    status = F.when(F.when(section, F.col("quality") == 0).otherwise(F.col("toxic") == 1), "mismatch").otherwise("verified")
    kind = F.when(section, "section").otherwise("math")
    fatal = ((kind == "section") & status.isin("missing", "mismatch", "ambiguous")) | ((kind == "math") & (status == "mismatch"))
    return table(spark, d, "labels").select("doc_id", fatal.alias("fatal"))


@query("pf14_model_resolution", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, n_name) AS model FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def pf14_model_resolution(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    joined = c.join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.col("n_name")).alias("model"))


@query("pf15_keyword_chapters", "WITH s AS (SELECT p_brand AS doc_id, p_partkey AS ordinal, 1 + p_size % 4 AS level FROM part), m AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS least FROM s) SELECT doc_id, ordinal FROM m WHERE level = least")
def pf15_keyword_chapters(spark, d):
    s = table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("ordinal"), (1 + F.col("p_size") % 4).alias("level"))
    return s.withColumn("least", F.min("level").over(Window.partitionBy("doc_id"))).where("level = least").select("doc_id", "ordinal")


@query("pf17_block_text", "SELECT conv_id, turn, CASE role WHEN 'system' THEN text WHEN 'user' THEN '- ' || replace(text, ' ', chr(10) || '- ') ELSE role || ': ' || text END AS text FROM conversations")
def pf17_block_text(spark, d):
    items = F.array_join(F.transform(F.split("text", " "), lambda x: F.concat(F.lit("- "), x)), "\n")
    text = F.when(F.col("role") == "system", F.col("text")).when(F.col("role") == "user", items).otherwise(F.concat(F.col("role"), F.lit(": "), F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))


@query("j2_unmatched", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_tax >= 0.08 AND l_discount >= 0.1)")
def j2_unmatched(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "lineitem").where("l_quantity >= 50 and l_tax >= 0.08 and l_discount >= 0.1"), F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey")


@query("j17_feedback_keys", "WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events GROUP BY 1), b AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events WHERE event_id % 30 <> 0 GROUP BY 1) SELECT user_id, coalesce(a.k = b.k, false) AS exact FROM a LEFT JOIN b USING (user_id)")
def j17_feedback_keys(spark, d):
    e = table(spark, d, "events")
    keys = lambda df, c: df.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias(c))
    return keys(e, "a").join(keys(e.where("event_id % 30 <> 0"), "b"), "user_id", "left").select("user_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("exact"))


@query("j21_batch_inputs", """WITH w AS (SELECT DISTINCT conv_id, unnest([conv_id % 300, (conv_id + 20) % 300, -1]) AS item_id FROM conversations WHERE conv_id % 3 <> 0)
SELECT conv_id, item_id FROM w SEMI JOIN benchmark USING (item_id) UNION ALL SELECT DISTINCT conv_id, NULL FROM conversations WHERE conv_id % 3 = 0""")
def j21_batch_inputs(spark, d):
    """Inputs of the batch that a loop names; one without a list takes all of them, which one row says."""
    loops = table(spark, d, "conversations").select("conv_id").distinct()
    ids = F.array(F.col("conv_id") % 300, (F.col("conv_id") + 20) % 300, F.lit(-1).cast("long"))
    named = loops.where("conv_id % 3 <> 0").select("conv_id", F.explode(F.array_distinct(ids)).alias("item_id"))
    found = named.join(table(spark, d, "benchmark").select("item_id"), "item_id", "left_semi").select("conv_id", "item_id")
    return found.unionByName(loops.where("conv_id % 3 = 0").select("conv_id", F.lit(None).cast("long").alias("item_id")))


@query("a3_keyword_groups", "SELECT lower(p_type) AS term, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS refs FROM part GROUP BY 1")
def a3_keyword_groups(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_type").alias("term")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("refs"))


@query("a4_warning_counts", "SELECT quality AS kind, toxic AS status, count(*) AS n FROM labels WHERE NOT (quality = 1 AND toxic = 0) GROUP BY ALL")
def a4_warning_counts(spark, d):
    return table(spark, d, "labels").where("not (quality = 1 and toxic = 0)").groupBy(F.col("quality").alias("kind"), F.col("toxic").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a11_high_water", "SELECT user_id, max(event_id) AS high_water, CASE max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) WHEN 0 THEN 'absent' WHEN 1 THEN 'discarded' ELSE 'reviewed' END AS disposition FROM events GROUP BY user_id")
def a11_high_water(spark, d):
    rank = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    name = F.when(rank == 0, "absent").when(rank == 1, "discarded").otherwise("reviewed")
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("high_water"), F.max_by(name, rank).alias("disposition"))


@query("a15_first_by_term", "SELECT p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def a15_first_by_term(spark, d):
    w = Window.partitionBy(F.lower("p_type")).orderBy("p_partkey")
    return table(spark, d, "part").withColumn("r", F.row_number().over(w)).where("r = 1").select("p_partkey", "p_type")


@query("a17_unique_aliases", "SELECT c_custkey FROM (SELECT *, count(*) OVER (PARTITION BY floor(c_acctbal)) AS n FROM customer) WHERE n = 1")
def a17_unique_aliases(spark, d):
    return table(spark, d, "customer").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.floor("c_acctbal")))).where("n = 1").select("c_custkey")


@query("a18_unique_headers", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY lower(string_split(text, chr(10))[1])) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def a18_unique_headers(spark, d):
    head = F.lower(F.element_at(F.split("text", "\n"), 1))
    return table(spark, d, "documents").where("text is not null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(head))).where("n = 1").select("doc_id")


@query("a19_least_memory", "SELECT c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) AS source, min(c_acctbal) AS fraction FROM customer GROUP BY ALL")
def a19_least_memory(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("source"), F.min("c_acctbal").alias("fraction"))


@query("w10_first_occurrence", """WITH u AS (SELECT doc_id AS unit, strpos(text, 'License') AS p, coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM documents WHERE text IS NOT NULL) SELECT min(offs + p - 1)::BIGINT AS first FROM u WHERE p > 0""")
def w10_first_occurrence(spark, d):
    units = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("unit"), "text")
    hits = units.where(F.contains("text", F.lit("License"))).select(F.lit("License").alias("term"), F.struct("unit", F.instr("text", "License").alias("at")).alias("f"))
    firsts = hits.groupBy("term").agg(F.min("f").alias("f")).select("term", "f.*")
    return search.first_offsets(units, firsts).agg(F.min("first").alias("first"))


@query("l5_caps", "SELECT user_id, array_to_string(list(event_id ORDER BY event_id)[1 : 10], ',') AS first_ten FROM events GROUP BY user_id")
def l5_caps(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    ten = table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 10")
    return ten.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("first_ten"))


@query("l6_merged_hits", "SELECT doc_id, start, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT doc_id, strpos(text, term) AS start, term FROM documents, (VALUES ('the'), ('then'), ('th'), ('License')) t(term) WHERE strpos(text, term) > 0) GROUP BY ALL")
def l6_merged_hits(spark, d):
    found = F.array(*(F.struct(F.instr("text", t).alias("start"), F.lit(t).alias("term")) for t in ("the", "then", "th", "License")))
    each = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(found).alias("x")).where("x.start > 0")
    return each.groupBy("doc_id", "x.start").agg(F.array_join(F.array_sort(F.collect_list("x.term")), ",").alias("terms"))


@query("u1_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u1_union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u2_union_all", "SELECT 'customer' AS origin, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier")
def u2_union_all(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_name").alias("name")))


@query("u3_difference", "SELECT l_orderkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def u3_difference(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).exceptAll(table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey"))


@query("u4_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u4_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("u5_ordered_dedupe", "SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id")
def u5_ordered_dedupe(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("p"))
    g = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("p", "event_type"))).alias("k"))
    return g.select("user_id", F.array_join(F.transform("k", lambda x: x["event_type"]), ",").alias("kinds"))


@query("sx15_failure_summary", r"SELECT event_id, CASE WHEN regexp_matches(event_type, '^[a-z_]{1,64}$') THEN event_type END AS code, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS status FROM events")
def sx15_failure_summary(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.when(F.rlike("event_type", F.lit("^[a-z_]{1,64}$")), F.col("event_type")).alias("code"), F.expr("try_cast(get_json_object(props, '$.k') as int)").alias("status"))


@query("sk11_worker_targets", "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_id % 40 AS target, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE target > 32 OR event_id <= p")
def sk11_worker_targets(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 40).alias("target"), F.lag("event_id").over(w).alias("p"))
    return e.where("target > 32 or event_id <= p").select("user_id", "event_id")


@query("sc13_workspace_tables", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def sc13_workspace_tables(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
