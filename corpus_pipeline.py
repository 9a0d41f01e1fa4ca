"""Corpus pipeline: documents through five stages, each over everything that its predecessor kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns each row's
shard and its place there, as the sharding operator does. Edge cases are those of the operators called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.llm.common import stored, table
from folia.llm.decontaminate import clean
from folia.llm.mixing import mix
from folia.llm.near_dup import keep_one
from folia.llm.sharding import shard
from folia.llm.toxicity import keep_clean

N_SHARDS = 16


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs, N_SHARDS)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The learned and sketch-based stages have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
