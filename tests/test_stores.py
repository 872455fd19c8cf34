"""Record files, frozen releases, the ledger and the workbook sink."""

from __future__ import annotations

import glob
import hashlib
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from claimweave.operators import releases
from claimweave.plans import catalogue
from claimweave.sources import files, ledger, recordfiles


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_record_groups_are_the_same_however_files_are_cut(spark, tmp_path, split):
    rng = random.Random(8)
    want, lines_of = {}, {}
    for k in range(3):
        lines = [rng.choice(("10", "20", "30", "99", "")) + "x" * rng.randint(0, 30) for _ in range(rng.randint(50, 400))] if k else ["20 no start here"] * 5
        (tmp_path / f"f{k}.txt").write_text("\n".join(lines) + "\n")
        group = 0
        for n, line in enumerate(lines, 1):
            group += line.startswith("10")
            lines_of[f"f{k}.txt", n] = line
            if group:
                want[f"f{k}.txt", n] = (group, line)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = recordfiles.text_lines(spark, str(tmp_path))
        rows = recordfiles.record_groups(lines, F.col("line").startswith("10"), lines_each=17)
        assert {(os.path.basename(r.file), r.number): r.line for r in lines.collect()} == lines_of
        assert {(os.path.basename(r.file), r.number): (r.group, r.line) for r in rows.collect()} == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_truth_labels(spark):
    groups = spark.createDataFrame([("f", 1, 1, "10 AB  7"), ("f", 1, 2, "20short"), ("f", 1, 3, "99 AB  7"), ("f", 2, 4, "10 CDE89")], "file string, group long, number long, line string")
    spec = spark.createDataFrame([("10", "member_id", 4, 4, 8), ("10", "count", 8, 1, 8), ("20", "x", 1, 2, 8)], "record string, field string, start int, length int, record_length int")
    out = recordfiles.truth_labels(groups, spec, F.substring("line", 1, 2), ("member_id",)).orderBy("number", "start").collect()
    assert [tuple(r)[1:] for r in out] == [
        (1, 1, "10", "member_id", "AB  ", "AB", "critical", 4, 7), (1, 1, "10", "count", "7", "7", "standard", 8, 8), (2, 4, "10", "member_id", "CDE8", "CDE8", "critical", 4, 7), (2, 4, "10", "count", "9", "9", "standard", 8, 8),
    ]


def test_groups_know_their_head_over_stretches(spark, tmp_path):
    lines = ["x", "10a", "y", "10b"] + [f"z{k}" for k in range(40)] + ["10c", "10d", "w"]
    (tmp_path / "f.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "g.txt").write_text("v\n" * 9)
    numbered = recordfiles.text_lines(spark, str(tmp_path))
    got = {r.number: (r.line, r.group, r.head) for r in recordfiles.record_groups(numbered, F.col("line").startswith("10"), lines_each=5).collect()}
    heads = [[x for x in lines[: n + 1] if x.startswith("10")] for n in range(len(lines))]
    assert got == {n + 1: (lines[n], len(h), h[-1]) for n, h in enumerate(heads) if h}


def test_lines_are_numbered_where_they_are(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a\n" * 10)
    plan = recordfiles.text_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "line" not in "".join(x for x in plan.splitlines() if "Sort [" in x or "Exchange" in x)


def test_truth_labels_of_orders_like_a_join(spark, tmp_path):
    """Lines without an order are no one's; two orders of a number have the lines each."""
    spark.createDataFrame([(1, "O"), (2, "F"), (2, "F"), (3, "P")], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 7, 5.0), (2, 8, 6.0), (9, 9, 9.0), (None, 9, 9.0)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalogue.queries()["truth_labels"](spark, str(tmp_path))
    got = {(int(r.claim), r.field, r.normalized): (r.n, r.criticality) for r in found.collect()}
    want = {(k, "order_id", f"{k:010d}"): (n, "standard") for k, n in ((1, 1), (2, 2), (3, 1))} | {(k, "status", s): (n, "standard") for k, s, n in ((1, "O", 1), (2, "F", 2), (3, "P", 1))}
    want |= {(k, "part_id", f"{p:08d}"): (n, "standard") for k, p, n in ((1, 7, 1), (2, 8, 2))} | {(k, "total_units", u): (n, "critical") for k, u, n in ((1, "5", 1), (2, "6", 2))}
    assert got == want
    assert "SortMergeJoin [record" not in found._jdf.queryExecution().executedPlan().toString()


def test_release_differences_name_every_file(spark, tmp_path):
    for name, text in {"a.yaml": b"one\r\ntwo\r\n", "sub/b.bin": b"\x00\r\n", "c.yaml": b"changed", "new.yaml": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    found = releases.folder_files(spark, str(tmp_path)).select("path", releases.content_digest(F.col("content"), F.col("path").endswith(".yaml")).alias("digest"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = [("a.yaml", sha(b"one\ntwo\n").upper()), ("sub/b.bin", sha(b"\x00\r\n")), ("c.yaml", sha(b"as it was")), ("gone.yaml", sha(b"")), ("two.yaml", "1"), ("two.yaml", "2")]
    differences = releases.release_differences(found, spark.createDataFrame(manifest, "path string, digest string"))
    assert {r.path: r.status for r in differences.collect()} == {"a.yaml": "SAME", "sub/b.bin": "SAME", "c.yaml": "CHANGED", "gone.yaml": "MISSING", "new.yaml": "ADDED", "two.yaml": "AMBIGUOUS"}
    gate = releases.integrity_gate(differences.withColumn("release", F.lit("r")), "release", F.lit("FROZEN")).first()
    assert tuple(gate) == ("r", "BROKEN", 3, "AMBIGUOUS:two.yaml")
    same = differences.filter("status IN ('SAME', 'ADDED')").withColumn("release", F.lit("r"))
    assert releases.integrity_gate(same, "release", F.lit("FROZEN")).first().decision == "PASS"
    assert releases.integrity_gate(same, "release", F.lit("FROZEN"), allow_added=False).first().decision == "BROKEN"
    assert releases.integrity_gate(same, "release", F.lit("DRAFT")).first().decision == "NOT_FROZEN"


def test_of_two_writers_at_one_head_one_appends(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    assert book.head() == (0, ledger.GENESIS) and book.rows() is None and book.broken() == []
    assert book.append(spark.range(5).toDF("id"), "first")
    assert not book.append(spark.range(5).toDF("id"), "first")  # sent again
    at, outcome = book.head(), {}

    def write(name: str) -> None:
        try:
            outcome[name] = ledger.Ledger(spark, book.folder).append(spark.range(10, 13).toDF("id").withColumn("by", F.lit(name)), name, at)
        except ledger.HeadMoved:
            outcome[name] = "moved"

    threads = [threading.Thread(target=write, args=(n,)) for n in ("left", "right")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcome.values(), key=str) == ["moved", True] or sorted(map(str, outcome.values())) == ["True", "moved"]
    winner = next(n for n, x in outcome.items() if x is True)
    rows = book.rows().collect()
    assert len(rows) == 8 and {r.by for r in rows if r.batch != "first"} == {winner} and book.head()[0] == 2
    assert book.rows(upto=1).count() == 5 and book.broken() == []
    loser = next(n for n in outcome if n != winner)
    assert book.append(spark.range(1).toDF("id"), loser) and book.head()[0] == 3
    # what a writer leaves that broke off isn't read; what is changed afterwards is found
    os.makedirs(f"{book.folder}/batches/{'0' * 32}")
    assert book.rows().count() == 9
    place = book.commits()[0]["place"]
    spark.range(6).toDF("id").write.mode("overwrite").parquet(f"{book.folder}/{place}")
    assert book.broken() == ["1: content"]
    path = f"{book.folder}/commits/{2:012d}.json"
    with open(path, encoding="utf-8") as f:
        text = f.read()
    with open(path, "w", encoding="utf-8") as f:
        f.write(text.replace('"rows": 3', '"rows": 4'))
    assert book.broken() == ["1: content", "2: digest"]


def test_closures_need_two_people(spark):
    tasks = spark.createDataFrame([("a", "OPEN"), ("b", "OPEN"), ("c", "OPEN"), ("d", "OPEN"), ("e", "VERIFIED_BY_HUMAN"), ("f", "OPEN")], "task string, status string")
    corrections = spark.createDataFrame([("a", 1, " Zoë O'Neil ", "r1"), ("b", 1, "J0HN", "r1"), ("b", 2, "JOHN", "r2"), ("c", 1, "ANN", "r1"), ("d", 1, "42", "r1"), ("e", 1, "EVE", "r1"), ("f", 1, "", "r3")], "task string, version int, value string, reviewer string")
    approvals = spark.createDataFrame([("a", 2, "r2"), ("b", 3, "r2"), ("b", 4, "r9"), ("c", 2, "r1"), ("d", 2, "r2"), ("e", 2, "r2")], "task string, version int, approver string")
    out = {r.task: tuple(r)[1:] for r in ledger.closures(tasks, corrections, approvals).collect()}
    assert out == {
        "a": ("VERIFIED_BY_HUMAN", "Zoë O'Neil", "r1", "r2", ""), "b": ("VERIFIED_BY_HUMAN", "JOHN", "r2", "r9", "CORRECTION_INVALID,SELF_APPROVAL"), "c": ("PENDING_SECOND_APPROVAL", "ANN", "r1", None, "SELF_APPROVAL"),
        "d": ("OPEN", None, None, None, "CORRECTION_INVALID,NOTHING_TO_APPROVE"), "e": ("VERIFIED_BY_HUMAN", None, None, None, "NOTHING_TO_APPROVE,TASK_NOT_OPEN"), "f": ("OPEN", None, None, None, "CORRECTION_INVALID"),
    }
    audit = ledger.audit_rows(ledger.closures(tasks, corrections, approvals)).collect()
    assert sorted((r.task, r.event, r.actor) for r in audit) == [("a", "CORRECTION_SUBMITTED", "r1"), ("a", "VERIFIED_BY_HUMAN", "r2"), ("b", "CORRECTION_SUBMITTED", "r2"), ("b", "VERIFIED_BY_HUMAN", "r9"), ("c", "CORRECTION_SUBMITTED", "r1")]
    assert next(r.correction_hash for r in audit if r.task == "c") == hashlib.sha256(b"ANN").hexdigest()


def test_workbooks_are_written_whole_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(files.WorkbookSource)
    folder = str(tmp_path / "book")
    rows = [(k, f"a<b&'\"{k}\x01", None if k % 3 else " padded ") for k in range(100)]
    df = spark.createDataFrame(rows, "id int, text string, note string").repartition(3)
    df.write.format("workbook").mode("append").option("path", folder).option("most_rows", "20").save()
    schema = "id string, text string, note string"
    read = lambda: sorted(tuple(r) for p in glob.glob(f"{folder}/*.xlsx") for r in spark.read.format("workbook").schema(schema).option("path", p).option("sheet", "1").load().collect())
    want = sorted((str(k), t.replace("\x01", "?"), n or "") for k, t, n in rows)
    assert [tuple(x or "" for x in r) for r in read()] == want and len(glob.glob(f"{folder}/*.xlsx")) >= 6
    before = read()
    failing = df.withColumn("text", F.when(F.col("id") == 77, F.raise_error("no")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        failing.write.format("workbook").mode("append").option("path", folder).save()
    assert read() == before and [n for n in os.listdir(folder) if n.startswith(".")] == []
    df.limit(3).select("id", F.array("id", "id").alias("text"), F.struct("id").alias("note")).write.format("workbook").mode("append").option("path", folder).save()
    assert len(read()) == 103 and any(r[1].startswith("[") and r[2] == '{"id": ' + r[0] + "}" for r in read())
    df.limit(2).write.format("workbook").mode("overwrite").option("path", folder).save()
    assert len(read()) == 2
