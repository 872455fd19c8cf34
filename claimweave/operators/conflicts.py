"""Two fields with one best place: the weaker moves on, until every field has a place of its own or none left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Rounds that are one job.
ROUNDS_EACH = 3


def resolved_conflicts(candidates: DataFrame, group: list[str], field: str, place: list[Column], strength: list[Column], order: list[Column]) -> DataFrame:
    """The candidate each field ends with: ``candidates`` rows, one for each field that keeps one.

    A field claims its candidates in its own ``order``. Of the fields of a
    group that claim one place the strongest by ``strength`` (highest first;
    equal ones: the smaller name) holds it, and the others claim their next.
    Claims only move on and a place only changes to a stronger holder, so the
    result doesn't depend on the sequence of steps: it is the one of a rule that
    moves one field at a time. Every round but the last moves some field on, so
    there are at most as many rounds as a group has candidates. Groups without a
    conflict are done and leave the rounds, and so do candidates that are lost.
    A null place is a place; rows of no group or field are left out.

    A group's candidates are brought together once and then only sorted, round
    after round, in the task that has them; what is open after a few rounds is
    written and read again.
    """
    key, tasks = [*group, field], int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # sorted many times, so by number and not by size
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    rows, out = candidates.dropna(subset=key).repartition(tasks, *group).withColumns({"__rank": rank, "__at": F.lit(1)}), None
    while True:  # each time every open group has fewer candidates
        rows = rows.withColumns({"__place": F.struct(*(c.alias(f"p{k}") for k, c in enumerate(place))), "__weak": F.struct(*((-c).alias(f"s{k}") for k, c in enumerate(strength)), F.col(field).alias("__name"))})
        for k in range(ROUNDS_EACH):
            claims = F.col("__rank") == F.col("__at")
            held = F.row_number().over(Window.partitionBy(*group, "__place", "__claims").orderBy("__weak"))
            rows = rows.withColumn("__claims", claims).withColumn("__loses", (F.col("__claims") & (held > 1)).cast("int"))
            if k == ROUNDS_EACH - 1:
                rows = rows.withColumn("__open", F.max("__loses").over(Window.partitionBy(*group)) == 1)
            rows = rows.withColumn("__at", F.col("__at") + F.max("__loses").over(Window.partitionBy(*key))).filter(F.col("__rank") >= F.col("__at"))
        rows = staged(rows.filter(F.col("__open") | (F.col("__rank") == F.col("__at"))).select(*candidates.columns, "__rank", "__at", "__open"), "round")
        settled = rows.filter("NOT __open").select(*candidates.columns)
        out = settled if out is None else out.unionByName(settled)
        rows = rows.filter("__open").drop("__open")
        if rows.isEmpty():
            return out
        rows = rows.repartition(tasks, *group)
