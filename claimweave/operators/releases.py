"""Frozen releases: digests of what is there, held against a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), content of all files of a folder and what is below it; a file is one value, 2 GB at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    path = F.substring_index(F.regexp_replace("path", "^[a-z]+:/+", "/"), f"{root}/", -1)
    return files.select(path.alias("path"), "content")


def content_digest(content: Column, text: Column) -> Column:
    """SHA-256 of a content; line ends of text count as one newline each, whatever system wrote them."""
    plain = F.replace(F.replace(content.cast("string"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(text, F.sha2(plain, 256)).otherwise(F.sha2(content, 256))


def release_differences(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, status, expected, actual of every file of a release: SAME, CHANGED, MISSING, ADDED, or AMBIGUOUS where a manifest names a path with two digests.

    ``files``: path, digest of what is there; ``manifest``: path, digest.
    """
    named = manifest.groupBy("path").agg(F.min(F.lower("digest")).alias("expected"), F.countDistinct(F.lower("digest")).alias("__n"))
    there = files.groupBy("path").agg(F.min("digest").alias("actual"))
    status = (
        F.when(F.col("__n") > 1, "AMBIGUOUS").when(F.col("actual").isNull(), "MISSING").when(F.col("expected").isNull(), "ADDED").when(F.col("expected") == F.col("actual"), "SAME").otherwise("CHANGED")
    )
    return named.join(there, "path", "full").select("path", status.alias("status"), "expected", "actual")


def integrity_gate(differences: DataFrame, release: str, state: Column, allow_added: bool = True) -> DataFrame:
    """release, decision, broken, first: a release passes if it is FROZEN and all that its manifest names is as it was; else how many files aren't, and the first by status and name.

    ``differences`` has the column ``release``. What a manifest doesn't name is
    only looked at if ``allow_added`` is false.
    """
    bad = ~F.col("status").isin("SAME", *(["ADDED"] if allow_added else []))
    rows = differences.groupBy(release).agg(F.bool_and(F.coalesce(state == "FROZEN", F.lit(False))).alias("__frozen"), F.count_if(bad).alias("n"), F.min(F.when(bad, F.concat_ws(":", "status", "path"))).alias("first"))
    decision = F.when(~F.col("__frozen"), "NOT_FROZEN").when(F.col("n") > 0, "BROKEN").otherwise("PASS")
    return rows.select(release, decision.alias("decision"), F.col("n").alias("broken"), "first")
