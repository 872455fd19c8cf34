"""Groups of lines in text files that are read in splits cut anywhere, and labels from their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .staging import staged


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1, in the file), line of every line of the text files at ``path``.

    A split knows where it begins in its file, and its lines come in order; what
    the splits before it hold is a sum over a row for each split, which is sent
    to all tasks. So lines are numbered in the file's order with no task that
    has the whole file, without moving them, and the same however files are cut.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    rows = staged(read, "lines")  # written: ``at`` must not depend on another run
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    starts = splits.select("file", "split", "first", _sum_before("n", "split").alias("before"))
    # a split is read by one task from end to end, so ``at`` has no gaps in it
    return rows.join(F.broadcast(starts), ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("number"), "line")


def _before(order: str) -> WindowSpec:
    """The rows of a file before each; for a row for each split or stretch."""
    return Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(count: str, order: str) -> Column:
    return F.coalesce(F.sum(count).over(_before(order)), F.lit(0))


def record_groups(lines: DataFrame, starts: Column, lines_each: int = 100_000) -> DataFrame:
    """``lines`` (file, number, line) with group: how many lines for which ``starts`` holds come up to it in its file, and head: the last one of these; lines before the first are left out.

    Starts are counted in stretches of ``lines_each`` lines, then over the
    stretches of a file; lines are moved once.
    """
    rows = lines.select("*", F.floor((F.col("number") - 1) / lines_each).alias("__stretch"), F.coalesce(starts, F.lit(False)).alias("__starts"))
    sums = rows.groupBy("file", "__stretch").agg(F.count_if("__starts").alias("__n"), F.max(F.when(F.col("__starts"), F.col("number"))).alias("__last"))
    sums = sums.select("file", "__stretch", _sum_before("__n", "__stretch").alias("__before"), F.last("__last", True).over(_before("__stretch")).alias("__at"))
    heads = rows.filter("__starts").select("file", F.col("number").alias("__at"), F.col("line").alias("__head"))
    to_here = Window.partitionBy("file", "__stretch").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.select("*", F.count_if("__starts").over(to_here).alias("__in"), F.last(F.when(F.col("__starts"), F.col("line")), True).over(to_here).alias("__own"))
    known = inside.join(sums.join(heads, ["file", "__at"], "left").drop("__at"), ["file", "__stretch"])
    return known.select(*lines.columns, (F.col("__before") + F.col("__in")).alias("group"), F.coalesce("__own", "__head").alias("head")).filter("group > 0")


def truth_labels(groups: DataFrame, spec: DataFrame, record: Column, critical: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """file, group, number, record, field, raw, normalized, criticality, start, end and the columns ``keep`` of every field of the lines whose record has a specification of their length.

    ``spec``: record, field, start (from 1), length, record_length, a row for
    each field, sent to all tasks. ``record`` is a line's record name. A field is critical if its
    name holds one of ``critical``.
    """
    s = spec.select("record", "field", "start", "length", "record_length")
    rows = groups.withColumn("record", record).join(F.broadcast(s), "record").filter(F.length("line") == F.col("record_length"))
    raw = F.substring(F.col("line"), F.col("start"), F.col("length"))
    key = F.array(*map(F.lit, critical)).cast("array<string>")
    level = F.when(F.exists(key, lambda k: F.contains(F.col("field"), k)), "critical").otherwise("standard")
    return rows.select("file", "group", "number", "record", "field", raw.alias("raw"), F.trim(raw).alias("normalized"), level.alias("criticality"), "start", (F.col("start") + F.col("length") - 1).alias("end"), *keep)
