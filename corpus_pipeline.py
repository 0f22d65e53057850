"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, benchmark
decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame, which is written as Parquet and read again as the
next stage's input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfsort.llm.common import scratch_path, table
from shelfsort.llm.stages import STAGES as _STAGES

STAGES = list(_STAGES)

#: SQL can't express the trained classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
