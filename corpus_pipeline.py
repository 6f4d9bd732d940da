"""The corpus pipeline: stages over ``documents``, each reading what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrapanel.llm import stages
from terrapanel.llm.common import stored, table

STAGES = [
    ("quality", stages.good_quality),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("byte_bpe", stages.byte_bpe),
]

#: Weak labels, weighted sampling and edit distances aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
