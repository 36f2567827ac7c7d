"""The corpus pipeline: five stages, each one operator of seqloom.llm over the table documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import stages
from seqloom.llm.common import settled, stored, table

STAGES = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.exact_dedup),
    ("near_dedup", stages.near_dedup),
    ("mixing", stages.mixing),
    ("bpe", stages.bpe),
]

#: Language ID learns a model and near-dedup follows chains of links: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage gives; what the stages before it wrote is deleted once they stand."""

    def stages_in_turn() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)

    return settled(spark, "pipeline", stages_in_turn)
