"""Streaming jobs over the event bus: windows, duplicates, outbox, dead letters, budgets."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.staging import shared_folder


def event_stream(spark: SparkSession, path: str, files_each: int | None = None) -> DataFrame:
    """Events from Parquet files as a stream, with times as timestamps."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    # a pattern, as a stream takes a plain path for a folder
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def run_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Run a stream over what is there; ``write`` gets each micro-batch, its number and the output folder.

    Output and checkpoint are in the shared folder. A batch that is run again
    after a failure has the same number, and must overwrite what it wrote.
    """
    base = f"{shared_folder(stream.sparkSession)}/claimweave/{uuid.uuid4().hex}/{name}"
    out = f"{base}/out"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, n: write(df, n, out)).start()
    query.awaitTermination()
    return out


def _overwrite(df: DataFrame, n: int, out: str) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch={n}")


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows that a stream puts out, with the number of their batch."""
    return stream.sparkSession.read.parquet(run_batches(stream, name, _overwrite, mode))


def event_windows(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by window and type. Updates come out; the last one of a window holds."""
    sums = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    rows = collected(sums.select(F.col("w.start").alias("start"), "event_type", "n", "total"), "windows", "update")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select("start", "event_type", "x.n", "x.total")


def without_replays(stream: DataFrame, key: str, late: str) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return collected(stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]), "once").drop("batch")


def outbox_relay(stream: DataFrame, topic: str) -> DataFrame:
    """The published log of an outbox: key, topic, envelope, and its place in the batch and key.

    Events of one key stay in order; a batch that is retried replaces its own
    output, so each event is in the log once.
    """

    def publish(df: DataFrame, n: int, out: str) -> None:
        place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        envelope = F.to_json(F.struct("event_id", "event_type", "value"))
        df.select(F.col("user_id").alias("key"), F.lit(topic).alias("topic"), "event_id", envelope.alias("envelope"), place.alias("place")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.sparkSession.read.parquet(run_batches(stream, "outbox", publish))


def split_dead_letters(stream: DataFrame, schema: str, rejects: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead) rows: those whose ``props`` parse by ``schema`` and don't meet ``rejects``, and the others with a reason."""

    def split(df: DataFrame, n: int, out: str) -> None:
        parsed = df.withColumn("parsed", F.from_json("props", schema, {"mode": "PERMISSIVE"}))
        reason = F.when(F.col("parsed").isNull() | F.col("parsed.k").isNull(), "UNPARSEABLE").when(F.expr(rejects), "REJECTED")
        marked = parsed.withColumn("reason", reason).persist()
        marked.filter("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{out}/good/batch={n}")
        marked.filter("reason IS NOT NULL").drop("parsed").write.mode("overwrite").parquet(f"{out}/dead/batch={n}")
        marked.unpersist()

    out = run_batches(stream, "letters", split)
    read = stream.sparkSession.read
    return read.parquet(f"{out}/good"), read.parquet(f"{out}/dead")


#: Groups that users are dealt to; their state is kept together, so it can't be changed for a stream that has run.
SHARES = 128


def spend_within_budget(stream: DataFrame, budget: float) -> DataFrame:
    """Each user's requests of a day, in order, granted as long as the day's spend with it stays within the budget.

    What a day has spent so far is state, so it carries over micro-batches;
    within one, a user's events are put in order of time first. A call and a
    row of state are for a share of the users and a day, as a call costs
    milliseconds and most users have a few events a day.
    """

    def grant(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        users = [None] * len(rows) if key[0] < 0 else rows["user_id"].tolist()
        granted = []
        for user, value in zip(users, rows["value"].tolist(), strict=True):
            after = spent.get(user, 0.0) + value
            granted.append(after <= budget)
            if granted[-1]:
                spent[user] = after
        state.update((list(spent), list(spent.values())))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "granted": granted})

    share = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.hash("user_id"), F.lit(SHARES)))
    days = stream.select(share.alias("share"), F.to_date("ts").alias("day"), "user_id", "event_id", "ts", "value")
    out = days.groupBy("share", "day").applyInPandasWithState(grant, "user_id long, event_id long, granted boolean", "users array<long>, spent array<double>", "append", GroupStateTimeout.NoTimeout)
    return collected(out, "budget").drop("batch")
