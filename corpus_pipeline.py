"""A corpus from raw documents: quality rules, near-dedup, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import decontaminate, mixing, quality, sharding, simhash
from tracemill.llm.common import drop, stash


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filter_quality(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target asks for."""
    return mixing.emit(docs)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy's shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("quality rules", _quality),
    ("near-dedup", _near_dedup),
    ("decontamination", _decontaminate),
    ("mixing", _mix),
    ("sharding", _shard),
]

#: The forest's and the fingerprints' verdicts have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{k}")
            if k:
                drop(before)  # the next stage is written
    return docs
