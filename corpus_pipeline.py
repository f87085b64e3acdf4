"""A training-data pipeline of corpus operators: quality, near duplicates, contamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of the documents. Between stages the
documents are written and read again, so a lost executor costs at most a stage. SQL cannot express the first stage; the
pipeline is tested against brute-force versions of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, mixing, ngram_join, quality, sharding
from vellum.llm.tables import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field calls good; it learns from labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, labels.where(~quality.held_out()))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return ngram_join.keep_one(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target words."""
    return mixing.apply_mix(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shards."""
    return sharding.assign_shards(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("contamination", contamination_stage), ("mixture", mixture_stage), ("shards", shard_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
