"""Changes to stored tables: conditional updates, retention, append with checks. Each writes a new version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_and_set(table: DataFrame, requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new table, outcomes): a request (key, expected_version, who) takes an OPEN task whose version it names.

    Of several requests for one task the first by name wins; the others, and
    those with another version, conflict.
    """
    first = F.row_number().over(Window.partitionBy(key, "expected_version").orderBy("who"))
    ranked = requests.withColumn("__turn", first)
    joined = ranked.join(table.select(key, "version", "status"), key, "left")
    won = (F.col("__turn") == 1) & (F.col("status") == "OPEN") & (F.col("version") == F.col("expected_version"))
    outcomes = joined.select(key, "who", F.when(F.coalesce(won, F.lit(False)), "CLAIMED").otherwise("CONFLICT").alias("outcome"))
    winners = outcomes.filter("outcome = 'CLAIMED'").select(key, F.col("who").alias("__who"))
    new = table.join(winners, key, "left")
    taken = F.col("__who").isNotNull()
    return new.select(
        *(F.when(taken, "IN_PROGRESS").otherwise(F.col(c)).alias(c) if c == "status" else (F.col(c) + taken.cast("int")).alias(c) if c == "version" else F.col(c) for c in table.columns), F.col("__who").alias("owner")
    ), outcomes


def retention_sweep(parents: DataFrame, children: DataFrame, key: str, at: str, as_of: Column, days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept parents, kept children, audit rows) after what is older than ``days`` is deleted with all below it."""
    cutoff = F.date_trunc("second", as_of) - F.make_dt_interval(F.lit(days))
    expired = parents.filter(F.col(at) < cutoff).select(key)
    audit = expired.select(key, F.lit("RETENTION_DELETED").alias("action"), cutoff.alias("cutoff"))
    return parents.filter(~(F.col(at) < cutoff) | F.col(at).isNull()), children.join(expired, key, "left_anti"), audit


def append_checked(table: DataFrame, new: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(table with the new rows, rejected rows): a key may come again only with the value it has; new rows must agree as well."""
    agreed = new.groupBy(key).agg(F.countDistinct(value).alias("__n"))
    checked = new.join(agreed, key).join(table.groupBy(key).agg(F.min(value).alias("__old")), key, "left")
    bad = (F.col("__n") > 1) | F.coalesce(F.col("__old") != F.col(value), F.lit(False))
    accepted = checked.filter(~bad & F.col("__old").isNull()).select(*table.columns).dropDuplicates([key])
    return table.unionByName(accepted), checked.filter(bad).select(*new.columns)
