"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, chat, decontaminate, jaccard_join, licenses, line_dedup, quality_fm, quality_rules, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": quality_fm.op1_quality_fm,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_bpe": bpe.op4_bpe,
    "op5_chat_format": chat.op5_chat_format,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_licenses": licenses.op9_licenses,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLES: dict[str, str] = {
    "op3_decontaminate": decontaminate.SQL,
    "op5_chat_format": chat.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op9_licenses": licenses.SQL,
}
