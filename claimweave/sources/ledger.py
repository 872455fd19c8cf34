"""An append-only table whose head moves by an atomic commit: of two writers at one head only one appends."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digest before the first commit.
GENESIS = "0" * 64


class HeadMoved(RuntimeError):
    """Another writer has appended meanwhile."""


class Ledger:
    """Batches of rows as Parquet, and a commit file for each, numbered, with the digest of the one before.

    A batch counts once its commit file is there. That file is made only if
    there is none of its number: by the file system's exclusive creation (on
    stores that have it, as HDFS and local ones do). What a writer leaves that
    breaks off before is never read. All machines must reach the folder.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """The commit files' contents, in order: a line for each batch."""
        p, fs = self._fs(f"{self.folder}/commits")
        if not fs.exists(p):
            return []
        rows = self.spark.read.option("wholetext", "true").text(f"{self.folder}/commits").collect()  # a file for each batch
        return sorted((json.loads(r.value) for r in rows), key=lambda c: c["number"])

    def head(self) -> tuple[int, str]:
        """Number and digest of the last commit; 0 and GENESIS before the first."""
        commits = self.commits()
        return (commits[-1]["number"], commits[-1]["digest"]) if commits else (0, GENESIS)

    def _create(self, path: str, text: str) -> bool:
        """Write a file if there is none; whether it was written."""
        url = urlparse(path)
        if url.scheme in ("", "file"):
            os.makedirs(os.path.dirname(url.path), exist_ok=True)
            held = f"{url.path}.{uuid.uuid4().hex}"
            hidden = os.path.join(os.path.dirname(held), f".{os.path.basename(held)}")
            with open(hidden, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(hidden, url.path)  # whole or not at all, and never over another one
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(hidden)
        p, fs = self._fs(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def append(self, rows: DataFrame, batch: str, at: tuple[int, str] | None = None) -> bool:
        """Append a batch at head ``at`` (the present one, if not given); false if the batch is in already.

        Raises ``HeadMoved`` if another writer has moved the head. Sending a
        batch again is harmless, also after a failure that hid the outcome.
        """
        commits = self.commits()
        if any(c["batch"] == batch for c in commits):
            return False
        now = (commits[-1]["number"], commits[-1]["digest"]) if commits else (0, GENESIS)
        number, digest = at or now
        if now != (number, digest):
            raise HeadMoved(f"the head is {now[0]}, not {number}")
        place = f"batches/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{place}")
        n, content = self._content(self.spark.read.parquet(f"{self.folder}/{place}"))
        commit = {"number": number + 1, "batch": batch, "place": place, "rows": n, "content": content, "previous": digest}
        commit["digest"] = self._digest(commit)
        if not self._create(f"{self.folder}/commits/{number + 1:012d}.json", json.dumps(commit)):
            raise HeadMoved(f"commit {number + 1} is another writer's")
        return True

    @staticmethod
    def _content(rows: DataFrame) -> tuple[int, str]:
        """Number of rows and a digest that doesn't depend on their order: sums of parts of the rows' digests."""
        d = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
        part = lambda k: F.coalesce(F.sum(F.conv(F.substring(d, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        first = rows.agg(F.count(F.lit(1)), *(part(k) for k in range(8))).first()
        return first[0], ":".join(str(x) for x in first[1:])

    @staticmethod
    def _digest(commit: dict) -> str:
        return hashlib.sha256("|".join(str(commit[k]) for k in ("number", "batch", "rows", "content", "previous")).encode()).hexdigest()

    def rows(self, upto: int | None = None) -> DataFrame | None:
        """All rows up to a commit, with its number and batch; None if there are none."""
        found = [c for c in self.commits() if upto is None or c["number"] <= upto]
        if not found:
            return None
        read = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.folder}/{c['place']}" for c in found))
        place = F.regexp_extract(F.col("_metadata.file_path"), r"(batches/[0-9a-f]{32})", 1)
        known = self.spark.createDataFrame([(c["place"], c["number"], c["batch"]) for c in found], "__place string, commit_number long, batch string")
        return read.withColumn("__place", place).join(known, "__place").drop("__place")

    def broken(self) -> list[str]:
        """What doesn't verify: gaps in the numbers, links that don't fit, digests or contents that aren't what was committed."""
        out, before, number = [], GENESIS, 0
        for c in self.commits():
            number += 1
            if c["number"] != number or c["previous"] != before:
                out.append(f"{c['number']}: not linked")
            if self._digest(c) != c["digest"]:
                out.append(f"{c['number']}: digest")
            elif self._content(self.spark.read.parquet(f"{self.folder}/{c['place']}")) != (c["rows"], c["content"]):
                out.append(f"{c['number']}: content")
            before, number = c["digest"], c["number"]
        return out


#: States of a task on its way to closure.
OPEN, PENDING, VERIFIED = "OPEN", "PENDING_SECOND_APPROVAL", "VERIFIED_BY_HUMAN"


def closures(tasks: DataFrame, corrections: DataFrame, approvals: DataFrame) -> DataFrame:
    """task, status, value, reviewer, approver, refusals of every task: closed only by a valid correction and another person's approval.

    ``tasks``: task, status. ``corrections``: task, version, value, reviewer; the
    first one of a task that is a name (letters, blanks, ' - .) counts, and only
    for an OPEN task. ``approvals``: task, version, approver; the first one by
    another person than the reviewer closes it. Refusals are listed by reason.
    """
    value = F.trim("value")
    named = value.rlike(r"^[\p{L} '.-]+$")
    c = corrections.withColumn("value", value).withColumn("__ok", F.coalesce(named, F.lit(False)))
    good = c.filter("__ok").groupBy("task").agg(F.min_by(F.struct("value", "reviewer"), F.struct("version", "reviewer", "value")).alias("c"))
    bad = c.groupBy("task").agg(F.count_if(~F.col("__ok")).alias("__invalid"))
    rows = tasks.join(good, "task", "left").join(bad, "task", "left").withColumn("c", F.when(F.col("status") == OPEN, F.col("c")))
    asked = approvals.join(rows.select("task", F.col("c.reviewer").alias("__reviewer"), F.col("c").isNotNull().alias("__has")), "task")
    other = F.col("__has") & (F.col("approver") != F.col("__reviewer"))
    verdict = asked.groupBy("task").agg(F.min_by(F.when(other, F.col("approver")), F.when(other, F.struct("version", "approver"))).alias("approver"), F.count_if(F.col("__has") & (F.col("approver") == F.col("__reviewer"))).alias("__own"), F.count_if(~F.col("__has")).alias("__early"))
    out = rows.join(verdict, "task", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    refusals = F.array_compact(F.array(F.when(zero("__invalid") > 0, "CORRECTION_INVALID"), F.when(zero("__own") > 0, "SELF_APPROVAL"), F.when(zero("__early") > 0, "NOTHING_TO_APPROVE"), F.when(F.col("c").isNull() & (F.col("status") != OPEN), "TASK_NOT_OPEN")))
    status = F.when(F.col("c").isNull(), F.col("status")).when(F.col("approver").isNotNull(), VERIFIED).otherwise(PENDING)
    return out.select("task", status.alias("status"), F.col("c.value").alias("value"), F.col("c.reviewer").alias("reviewer"), "approver", F.array_join(refusals, ",").alias("refusals"))


def audit_rows(closed: DataFrame, salt: Column | None = None) -> DataFrame:
    """task, event, actor, correction_hash: what a ledger keeps of closures; the value itself only as a digest."""
    digest = F.sha2(F.concat_ws("", salt if salt is not None else F.lit(""), F.coalesce("value", F.lit(""))), 256)
    submitted = closed.filter(F.col("value").isNotNull()).select("task", F.lit("CORRECTION_SUBMITTED").alias("event"), F.col("reviewer").alias("actor"), digest.alias("correction_hash"))
    verified = closed.filter((F.col("status") == VERIFIED) & F.col("value").isNotNull()).select("task", F.lit(VERIFIED).alias("event"), F.col("approver").alias("actor"), digest.alias("correction_hash"))
    return submitted.unionByName(verified)
