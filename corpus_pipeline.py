"""A training corpus from documents: language, near copies, benchmark passages, mixture, shards.

Every stage judges each row by its own values, so ids may be null or repeated
and rows equal. A null or blank text has no language and goes in the first
stage. A null language or source is a name of its own in the mixture. An empty
table gives an empty result, whatever the stage; further columns stay until the
last stage, whatever their names (but those that begin with two underscores).
Texts of any length are looked at whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import decontaminate, language_id, mixing, ngram_join, sharding
from claimweave.sources.staging import staged

#: The mixture keeps seven tenths of the tokens, each document at most once.
MIX = mixing.Mix(budget_percent=70, max_epochs=1)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no language, or no main one."""
    return language_id.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, null ids last; of rows equal in id and text one."""
    return ngram_join.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of whose words a twentieth or more are benchmark passages."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes."""
    return mixing.mixed(docs, MIX)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left, with its language and source where the table has them."""
    return sharding.byte_shards(docs, keep=tuple(c for c in ("lang", "source") if c in docs.columns))


STAGES = [
    ("language", known_language),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("mixture", to_weights),
    ("shards", into_shards),
]

#: Language and near-copy decisions have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
