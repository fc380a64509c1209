"""A training corpus from raw documents: quality, near copies, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadweave.llm import stages
from quadweave.llm.common import shared_table

STAGES = [
    ("quality classifier", stages.keep_quality),
    ("n-gram Jaccard join", stages.keep_one_of_near_copies),
    ("benchmark decontamination", stages.keep_uncontaminated),
    ("mixing sources to target weights", stages.mix),
    ("sharding", stages.shard),
]

#: The classifier is trained by gradient descent, which SQL can't express; tests check columns and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
