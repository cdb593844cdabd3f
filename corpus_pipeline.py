"""The corpus pipeline: five stages, each one operator of cohortlab.llm over all documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. Empty tables pass through as empty; further
columns are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import decontam, language, mixture, neardup, sharding
from cohortlab.llm.common import materialize, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told. Null, empty and letterless texts go; very
    short texts stay, whatever the confidence."""
    model = language.fit(language.training_texts(language.train_rows(docs)))
    return language.identified(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id. Of rows equal
    in id and text one stays; rows without an id only stand for groups that have no other."""
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, kept, or repeated up to three
    times. A null source is one of its own; rows equal in id and text share their fate."""
    return mixture.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; null texts count as empty ones."""
    return sharding.shard_rows(docs, shards=8)


STAGES = [("language", identify), ("neardup", deduplicate), ("decontamination", decontaminate), ("mixture", mix), ("sharding", shard)]

#: The first two stages fit or align; SQL cannot say them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
