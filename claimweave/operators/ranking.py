"""Choosing one of several candidates: score, rank, margin, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_with_margin(df: DataFrame, keys: list[str], score: str, ties: list[Column]) -> DataFrame:
    """The best row of each key with ``runner_up`` (score of the second) and ``margin``; ties by ``ties``.

    A key with one candidate has no runner-up, and its margin is its score.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    ranked = df.withColumn("__rank", F.row_number().over(w)).withColumn("runner_up", F.lead(score).over(w))
    return ranked.filter("__rank = 1").drop("__rank").withColumn("margin", F.col(score) - F.coalesce(F.col("runner_up"), F.lit(0).cast("double")))


def vote(df: DataFrame, keys: list[str], value: str, source: str, order: str, least_support: int, least_sources: int = 1) -> DataFrame:
    """The value with most support in each key, if it has enough, from enough sources, and more than any other.

    Ties for first place are no result: ``winner`` is then null. ``order`` says
    which of equally supported values came first, for the listing only.
    """
    votes = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("support"), F.countDistinct(source).alias("sources"), F.min(order).alias("first_seen"))
    w = Window.partitionBy(*keys).orderBy(F.col("support").desc(), "first_seen", value)
    best = votes.withColumn("__rank", F.row_number().over(w)).withColumn("next_support", F.coalesce(F.lead("support").over(w), F.lit(0))).filter("__rank = 1")
    won = (F.col("support") >= least_support) & (F.col("sources") >= least_sources) & (F.col("support") > F.col("next_support"))
    return best.select(*keys, F.when(won, F.col(value)).alias("winner"), "support", "next_support", "sources")
