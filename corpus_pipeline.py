"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``. A stage deletes its own scratch tables but the small
ones that its result reads; ``run`` deletes those too, and the stage's input,
once its output is written.

Defined results: rows with null or repeated ids are told apart by id and text;
null and empty texts fail the quality rules; other columns go through as they
are; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import scratch
from tessera.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("bpe", bpe.stage),
]

#: The first stage's classifier can't be expressed in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each but the last is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    with scratch.owner() as made:
        for name, stage in first:
            docs = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            made.keep(docs)
        return last(spark, docs, sf_dir)
