"""A training corpus in five stages: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and gets what the one before it kept, as Parquet. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import common, decontaminate, mixing, quality, shard, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, doesn't reject."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints within two bits, or five-word shingles alike by 0.8 or more."""
    return simhash.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, none for those it leaves out."""
    return mixing.take(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return shard.shards(docs, 8).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("source mixing", mixed),
    ("sharding", sharded),
]

#: SQL can't express the classifier, the fingerprints or the hashes; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
