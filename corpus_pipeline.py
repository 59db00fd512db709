"""From raw documents to shards: quality, near copies, benchmark leaks, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.cluster import passing_workspaces, workspace
from feedloom.llm import decontamination, mixing, quality, sharding, simhash


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.good_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, their shard of eight and their place in it."""
    return sharding.shard(docs)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_copy),
    ("leaks", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", make_shards),
]

# Trained scores and samples by hash can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, its intermediates are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = workspace(spark, f"stage-{name}")
        with passing_workspaces(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
