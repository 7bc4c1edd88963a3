"""From raw documents to packed sequences: quality, near duplicates, benchmarks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``. Stages must not see two different inputs under one path, so
``run`` writes each result as a table below spark.checkpoint.dir and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import common, decontaminate, near_dedup, packing, quality_hosts, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule or their host's failure rate rejects go."""
    return quality_hosts.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays."""
    return near_dedup.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go: for training, one leaked item is enough."""
    return decontaminate.drop(docs, common.read(spark, sf_dir, "benchmark"), least_items=1)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mask."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("secrets", secrets), ("packing", pack)]

#: Near duplicates by components could be said in SQL, the ids of a tokenizer file could not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
