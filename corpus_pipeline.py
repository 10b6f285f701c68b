"""The training-data pipeline: documents to shards, one stage after another.

Null texts are kept as empty ones by the first, third and fourth stage and are one
near-duplicate group for the second; null keys, repeated rows and empty tables have
the results that the operators state. Other columns are carried along as they are.

Every stage takes the whole table that its predecessor kept and is written as
Parquet before the next one reads it, so a lost executor costs one stage at most.
Each calls one operator; documents that a stage rejects are gone from the table.
"""

from pyspark.sql import DataFrame, SparkSession

from corpusqa.llm import decontaminate, mixing, sharding, simhash, toxicity
from corpusqa.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models accept, learned from `labels`."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: shingles of three words, at most three bits."""
    return simhash.keep_one(docs, shingle=3, most=3)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no passage of `benchmark`."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of 16, and of 17 if one more were added."""
    return sharding.assign_shards(docs, shards=16)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Fitted models and hashed searches have no SQL; tests compare the operators with brute force and the stages with their tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
