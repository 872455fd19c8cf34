"""Splits, samples, leakage audits and hash chains."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..sources.staging import staged


def ranked_split(df: DataFrame, key: str, seed: str, fraction: float, name: str = "split") -> DataFrame:
    """Keys in the order of their seeded digest; the first ``fraction`` (half to even, 1 to n - 1) are DEVELOPMENT, the rest HOLDOUT.

    The cut is found from counts per leading digest byte, and only the byte
    with the cut is ranked, so no task sorts all keys.
    """
    d = df.withColumn("__digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).withColumn("__byte", F.conv(F.substring("__digest", 1, 2), 16, 10).cast("int"))
    counts = d.groupBy("__byte").agg(F.count(F.lit(1)).alias("c"))  # 256 rows at most
    w = Window.orderBy("__byte")
    total = F.sum("c").over(Window.partitionBy())
    take = F.greatest(F.lit(1), F.least(F.bround(total * F.lit(fraction), 0).cast("long"), total - 1))
    before = F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("__byte", (take - before).alias("__left"), "c")
    placed = d.join(F.broadcast(places), "__byte")
    rank = F.row_number().over(Window.partitionBy("__byte").orderBy("__digest", key))
    inside = placed.filter("__left > 0 AND __left < c").withColumn(name, F.when(rank <= F.col("__left"), "DEVELOPMENT").otherwise("HOLDOUT"))
    whole = placed.filter("__left <= 0 OR __left >= c").withColumn(name, F.when(F.col("__left") >= F.col("c"), "DEVELOPMENT").otherwise("HOLDOUT"))
    return inside.unionByName(whole).select(*df.columns, name)


def largest_remainder(strata: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """``quota`` of each stratum: its share of ``target`` rounded down, and one more for the largest fractions (then by key)."""
    total = F.sum(size).over(Window.partitionBy())
    exact = F.col(size).cast("decimal(20,0)") * target
    floor = F.floor(exact / total).cast("long")
    rest = (exact - floor * total).cast("decimal(30,0)")
    with_floor = strata.withColumn("__floor", floor).withColumn("__rest", rest)
    left = F.lit(target) - F.sum("__floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col("__rest").desc(), key))
    return with_floor.withColumn("quota", F.least(F.col("__floor") + (rank <= left).cast("long"), F.col(size))).drop("__floor", "__rest")


def stratified_sample(df: DataFrame, stratum: str, key: str, target: int, seed: str) -> DataFrame:
    """A proportional sample: quotas by largest remainder, members by seeded digest."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size"))
    quotas = largest_remainder(sizes, stratum, "__size", target)
    order = hashing.digest_of(F.lit(seed), F.col(key))
    # the digests' first byte bounds what has to be ranked: rank within stratum and byte, plus what the bytes before hold
    d = df.withColumn("__digest", order).withColumn("__byte", F.substring("__digest", 1, 2))
    per = d.groupBy(stratum, "__byte").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(stratum).orderBy("__byte").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = per.select(stratum, "__byte", before.alias("__before")).join(quotas.select(stratum, "quota"), stratum)
    near = d.join(places, [stratum, "__byte"]).filter("__before < quota")
    rank = F.row_number().over(Window.partitionBy(stratum, "__byte").orderBy("__digest", key))
    return near.withColumn("__rank", rank + F.col("__before")).filter("__rank <= quota").select(*df.columns)


def quota_sample(rows: DataFrame, package: str, kind: str, targets: dict[str, int], seed: str) -> DataFrame:
    """package: whole packages, in the order of their seeded digest, each if it has rows of a kind that still lacks some, until no kind does.

    As long as a kind lacks rows, every package that has any is taken, so what
    has been taken of it is the running sum over all packages, whatever the
    other kinds do. The package at which that sum reaches the target closes the
    kind, and a package is taken if it comes no later than the close of one of
    its kinds: the same packages as going through them one by one. Sums per
    leading digits of the digest find each close; only the digits with the close
    are sorted, and a kind's packages are nowhere together. A kind that never
    reaches its target never closes; packages without a wanted kind, or with a
    null name, aren't taken.
    """
    wanted = {k: n for k, n in targets.items() if n > 0}
    counts = rows.filter(F.col(kind).isin(*wanted) & F.col(package).isNotNull()).groupBy(package, kind).agg(F.count(F.lit(1)).alias("__n"))
    digest = F.sha2(F.to_json(F.array(F.lit(seed), F.col(package).cast("string"))), 256)
    keyed = staged(counts.select(package, kind, "__n", F.struct(digest.alias("d"), F.col(package).alias("p")).alias("__key")).withColumn("__lead", F.substring("__key.d", 1, 4)), "packages")
    sums = keyed.groupBy(kind, "__lead").agg(F.sum("__n").alias("__in"))
    before = F.coalesce(F.sum("__in").over(Window.partitionBy(kind).orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = F.element_at(F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair)), F.col(kind)) if wanted else F.lit(0)
    cut = sums.withColumn("__before", before).filter((F.col("__before") < target) & (F.col("__before") + F.col("__in") >= target)).select(kind, "__lead", "__before")
    reached = F.col("__before") + F.sum("__n").over(Window.partitionBy(kind).orderBy("__key"))
    close = keyed.join(F.broadcast(cut), [kind, "__lead"]).withColumn("__reached", reached).filter(F.col("__reached") >= target).groupBy(kind).agg(F.min("__key").alias("__close"))  # a row for each kind
    taken = keyed.join(F.broadcast(close), kind, "left").filter(F.col("__close").isNull() | (F.col("__key") <= F.col("__close")))
    return taken.select(package).distinct()


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first of every group, then the second of every group, until ``limit``: a report's top rows."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("turn", rank).filter(F.col("turn") <= limit).orderBy("turn", group).limit(limit)


def leaking_identities(rows: DataFrame, identity: str, split: str) -> DataFrame:
    """Identities that occur in more than one split."""
    return rows.filter(F.col(identity).isNotNull()).groupBy(identity).agg(F.countDistinct(split).alias("splits"), F.count(F.lit(1)).alias("n")).filter("splits > 1")


def chain(events: DataFrame, ledger: str, order: str, payload: Column) -> DataFrame:
    """ledger, order, previous, hash: every event's digest takes in the one before of its ledger.

    A chain is one after the other by nature, so a ledger is one task's work;
    its events are sorted by Spark and pass by one batch at a time, of which
    only the last digest is kept. Ledgers may be long; ``order`` must be unique
    in one. A null payload adds nothing.
    """
    rows = events.select(ledger, order, payload.cast("string").alias("__p")).repartition(ledger).sortWithinPartitions(ledger, order)

    def fold(batches):
        now, head = object(), ""
        for batch in batches:
            before, after = [], []
            for of, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if of != now:
                    now, head = of, "GENESIS"
                before.append(head)
                head = hashlib.sha256((head if p is None else f"{head}|{p}").encode()).hexdigest()
                after.append(head)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.string()), pa.array(after, pa.string())], [ledger, order, "previous", "hash"])

    return rows.mapInArrow(fold, rows.drop("__p").schema.add("previous", "string").add("hash", "string"))


def verify_chain(events: DataFrame, ledger: str, order: str, payload: Column, previous: str = "previous", digest: str = "hash") -> DataFrame:
    """ledger, n, broken: events whose link or digest doesn't hold. Needs no fold, so ledgers may be long."""
    w = Window.partitionBy(ledger).orderBy(order)
    expected = F.coalesce(F.lag(digest).over(w), F.lit("GENESIS"))
    ok = (F.col(previous) == expected) & (F.col(digest) == F.sha2(F.concat_ws("|", F.col(previous), payload), 256))
    return events.withColumn("__ok", F.coalesce(ok, F.lit(False))).groupBy(ledger).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("__ok")).alias("broken"))


def balanced_top(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """``limit`` rows, as even over the groups as they allow: the first of each group by name, then the second of each."""
    return round_robin(df, group, order, limit).drop("turn")
