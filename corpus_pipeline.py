"""From raw documents to shards: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and all but the last return the
columns of documents. `run` writes each stage's result to the shared folder and reads it again.

Null and empty texts are no toxic texts, near copies of each other (one stays), no leaks, of size 0 and of 16 bytes.
Null ids and sources are kept as they are; repeated rows are one for near-dedup, and rows like others for the rest.
Long texts are read whole, other columns are kept up to the last stage, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import decontaminate, mixing, near_copies, sharding, toxicity
from usagelens.session import cut_lineage

#: Documents with this score or more go.
TOXIC_FROM = 0.3
SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below TOXIC_FROM; it learns from the labels of those at hand."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(docs, model, out="_toxicity").where(F.col("_toxicity") < TOXIC_FROM)
    return kept.drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a similarity of 0.8 or more over five-word shingles."""
    return near_copies.deduplicate(docs, shingle=5, at_least=0.8, errors=3)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of 0.8 or more similarity to a benchmark item."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.materialize(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: shard and slot, its size and checksum."""
    return sharding.manifest(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: A trained classifier comes first, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
