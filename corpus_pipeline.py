"""A corpus from raw documents: filter, deduplicate, decontaminate, mix and shard.

Each stage takes what the one before it kept. All but the last return the columns of ``documents``; the
last one returns the shard and slot of every remaining row.

Nulls and odd rows: a null text counts as empty. Rows without a doc_id pass the stages each on its own text; they
are in no group of near copies and so stay. Rows of one doc_id are one document to the near-copy and mixing stages:
each of its texts stays once, and all are repeated alike. Of equal or near texts the smallest doc_id stays. The mix
leaves documents out and repeats others, up to three times, so rows of one doc_id may follow in several shards'
slots. Columns beyond those of ``documents`` are carried along, whatever their names. Empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandtable.llm import decontaminate, mixing, quality, sharding, simhash
from strandtable.llm.common import shared_dir


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the positive-unlabelled classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash class, over five-word shingles."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them (up to three times, or not at all)."""
    return mixing.keep_taken(docs)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents into shards."""
    return sharding.shard(docs)


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", make_shards),
]

#: The classifier, the fingerprints and the search cannot be written in SQL; the stages are tested apart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
    return docs
