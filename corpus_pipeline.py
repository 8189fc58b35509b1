"""The corpus pipeline: toxicity, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, line_dedup, mixing, near_dedup, packing, toxicity

STAGES = [
    ("toxicity", toxicity.stage_toxicity),
    ("line dedup", line_dedup.stage_line_dedup),
    ("near dedup", near_dedup.stage_near_dedup),
    ("mixing", mixing.stage_mixing),
    ("packing", packing.stage_packing),
]

#: A learnt score, an edit join, a similarity join and a tokeniser are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
