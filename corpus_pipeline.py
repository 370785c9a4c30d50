"""Documents to packed windows of tokens: good ones, one of each group of copies, without private data, mixed, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import stages
from arbora.llm.common import save, table

STAGES = [
    ("quality", stages.keep_good),
    ("near_dedup", stages.keep_distinct),
    ("pii", stages.hide_private),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_windows),
]
#: A trained network and a signature are beyond SQL. tests/llm/test_quality_pipeline.py holds near_dedup and packing to plain
#: Python; quality, pii and mixing to their own operators, which tests of their own cover.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
