"""The corpus pipeline: five stages of the training-data operators over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from soundlake.llm import stages
from soundlake.llm.shared import checkpointed, table

STAGES = [
    ("quality classifier", stages.quality),
    ("line dedup", stages.lines),
    ("near dedup", stages.near),
    ("decontamination", stages.decontaminated),
    ("packing", stages.packed),
]

#: Similarity groups, resampling and the choice of buckets are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
