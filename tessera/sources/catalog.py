"""Content-addressed stores, catalogs and caches as tables.

A store row is identified by its digest; manifests name what should be there.
Writes are functional: each function returns the rows that the table should
hold, and the caller decides where to write them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, format, payload, digest and size of files; unknown suffixes get the format 'unsupported_source'."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", T.source_format(F.col("path")).alias("format"), F.col("content").alias("payload"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size"))


def store(rows: DataFrame) -> DataFrame:
    """One row for each (format, digest) of rows (format, media_type, payload): digest, size, media_type."""
    keyed = rows.select("format", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"), "media_type")
    return keyed.groupBy("format", "digest").agg(F.min("size").alias("size"), F.min("media_type").alias("media_type"))


def store_conflicts(rows: DataFrame) -> DataFrame:
    """(format, digest) stored with more than one media type."""
    keyed = rows.select("format", F.sha2("payload", 256).alias("digest"), "media_type")
    return keyed.groupBy("format", "digest").agg(F.count_distinct("media_type").alias("n")).where("n > 1")


def verify(manifest: DataFrame, payloads: DataFrame) -> DataFrame:
    """key and error of manifest rows (key, digest, size): source_not_found, source_manifest_invalid, source_corrupt or null."""
    seen = payloads.select("key", F.sha2("payload", 256).alias("d"), F.octet_length("payload").cast("long").alias("s"))
    both = manifest.join(seen, "key", "left")
    error = F.when(~T.is_digest(F.col("digest")) | (F.col("size") < 0), "source_manifest_invalid").when(F.col("d").isNull(), "source_not_found")
    return both.select("key", error.when((F.col("d") != F.col("digest")) | (F.col("s") != F.col("size")), "source_corrupt").alias("error"))


def bundle_differences(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path and what is wrong: missing, unlisted or changed; both sides have (path, digest)."""
    f = files.select("path", F.col("digest").alias("found"))
    both = manifest.select("path", "digest").join(f, "path", "full_outer")
    what = F.when(F.col("found").isNull(), "missing").when(F.col("digest").isNull(), "unlisted").when(F.col("digest") != F.col("found"), "changed")
    return both.select("path", what.alias("what")).where("what is not null")


def to_parse(sources: DataFrame, cache: DataFrame, contract: str) -> DataFrame:
    """Sources (digest) without a cache entry of this parser contract."""
    return sources.join(cache.where(F.col("parser_contract") == contract), "digest", "left_anti")


def catalog(records: DataFrame) -> DataFrame:
    """The last record of each (locator, format) by (at, digest), with all its identifiers."""
    w = Window.partitionBy("locator", "format").orderBy(F.desc("at"), F.desc("digest"))
    last = records.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("locator", "format", "digest", "at")
    ids = records.groupBy("locator", "format").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))
    return last.join(ids, ["locator", "format"])


def merged(entries: DataFrame) -> DataFrame:
    """Entries of one (format, digest) become one with all identifiers; local ones (without identifiers) stay apart."""
    known = entries.where("document_id is not null").groupBy("format", "digest").agg(F.array_join(F.array_sort(F.collect_set("document_id")), ",").alias("document_ids"), F.count(F.lit(1)).alias("entries"))
    local = entries.where("document_id is null").select("format", "digest", F.lit("").alias("document_ids"), F.lit(1).cast("long").alias("entries"))
    return known.unionByName(local)


def components(entries: DataFrame) -> DataFrame:
    """entry_id, component, the newest time and the sorted identifiers."""
    return entries.groupBy("entry_id", "component").agg(F.max("cached_at").alias("cached_at"), F.array_join(F.array_sort(F.collect_set("document_id")), ",").alias("document_ids"))


def listing(entries: DataFrame, document_ids: list, entry_ids: list, since) -> DataFrame:
    """Entries that any id filter admits (all without filters), not older than ``since``; newest, identified, then by id."""
    chosen = F.lit(not document_ids and not entry_ids)
    if document_ids:
        chosen = chosen | F.arrays_overlap("document_ids", F.array(*(F.lit(x) for x in document_ids)))
    if entry_ids:
        chosen = chosen | F.col("entry_id").isin(*entry_ids)
    return entries.where(chosen & (F.col("cached_at") >= F.lit(since))).orderBy(F.desc("cached_at"), F.desc("identified"), "entry_id")


def removal(entries: DataFrame, document_ids: list, entry_ids: list) -> tuple[DataFrame, DataFrame]:
    """What a removal would take, and what it would leave; needs a selector."""
    if not document_ids and not entry_ids:
        raise ValueError("a removal needs document ids or entry ids")
    hit = F.col("document_id").isin(*document_ids) if document_ids else F.lit(False)
    hit = hit | F.col("entry_id").isin(*entry_ids) if entry_ids else hit
    hit = F.coalesce(hit, F.lit(False))
    return entries.where(hit), entries.where(~hit)


def verified_read(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """key and status of requests whose cache row agrees in contract, source and document: hit, or the first that differs, or miss."""
    both = requests.join(cache.select("key", *(F.col(c).alias(f"c_{c}") for c in ("contract", "source", "document"))), "key", "left")
    status = F.when(F.col("c_contract").isNull(), "miss").when(F.col("c_contract") != F.col("contract"), "contract").when(F.col("c_source") != F.col("source"), "source")
    return both.select("key", status.when(F.col("c_document") != F.col("document"), "document").otherwise("hit").alias("status"))


def working_state(working: DataFrame, immutable: DataFrame) -> DataFrame:
    """id and digest: the working copy where there is one, else the immutable one."""
    both = working.select("id", F.col("digest").alias("w")).join(immutable.select("id", F.col("digest").alias("i")), "id", "full_outer")
    return both.select("id", F.coalesce("w", "i").alias("digest"), F.col("w").isNotNull().alias("edited"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two indexes (path, hash)."""
    both = before.select("path", F.col("hash").alias("b")).join(after.select("path", F.col("hash").alias("a")), "path", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def preferred(representations: DataFrame, contract: str) -> DataFrame:
    """One representation of each entry: of this contract, HTML before PDF before others, then the first."""
    rank = F.when(F.col("format") == "html", 0).when(F.col("format") == "pdf", 1).otherwise(2)
    w = Window.partitionBy("entry_id").orderBy(rank, "ordinal")
    return representations.where(F.col("contract") == contract).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table as Parquet in a folder of its name; the sink of a document workspace."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
