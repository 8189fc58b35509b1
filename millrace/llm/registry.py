"""Queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_topk, language, line_dedup, mixing, near_dedup, packing, quality_rules, resampling, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_resampling": resampling.op2_resampling,
    "op3_exact_topk": exact_topk.op3_exact_topk,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_language": language.op7_language,
    "op8_mixing": mixing.op8_mixing,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLES: dict[str, str] = {"op3_exact_topk": exact_topk.OP3_SQL}
