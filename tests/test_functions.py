"""Scalar expressions and operators on hand-made rows, and properties."""

from __future__ import annotations

import hashlib
import hmac
import uuid
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimweave.functions import dates, hashing, numbers, text
from claimweave.functions.similarity import compatible_form, sequence_ratio
from claimweave.operators import fixedwidth as fw
from claimweave.operators import governance, joins, metrics, ranking, rules, tables
from claimweave.operators.graph import connected_components
from claimweave.sources import files

relaxed = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, *values):
    """The column over one row with v0, v1 .."""
    return spark.createDataFrame([values], ", ".join(f"v{i} {'string' if isinstance(v, str | None.__class__) else 'double' if isinstance(v, float) else 'long'}" for i, v in enumerate(values))).select(column).first()[0]


@pytest.mark.parametrize(("raw", "amount"), [("12.345", "12.34"), ("12.355", "12.36"), ("($1,200.5)", "-1200.50"), ("|5|", "5.00"), ("", None), ("abc", None), (None, None)])
def test_money_is_half_even(spark, raw, amount):
    got = one(spark, text.money(F.col("v0")), raw)
    assert (None if got is None else str(got)) == amount


@pytest.mark.parametrize(
    ("raw", "day"), [("02-29-2020", "2020-02-29"), ("2020-02-29", None), ("2/3/69", "1969-02-03"), ("2/3/68", "2068-02-03"), ("01 05 2020", "2020-01-05"), ("12312019", "2019-12-31"), ("02-29-2021", None), ("13/13/2020", None), (None, None)]
)
def test_dates(spark, raw, day):
    got = one(spark, dates.parse_date(F.col("v0")), raw)
    assert (None if got is None else str(got)) == day


@pytest.mark.parametrize(
    ("raw", "name"),
    [("Doe, John Q Jr.", ("DOE", "JOHN", "Q", "JR")), ("John Q Public", ("PUBLIC", "JOHN", "Q", None)), ("Cher", ("CHER", None, None, None)), ("van Dyke,  Ann", ("VAN", "DYKE", "ANN", None))],
)
def test_person_names(spark, raw, name):
    assert tuple(one(spark, text.person_name(F.col("v0")), raw)) == name


@relaxed
@given(st.integers(min_value=10**8, max_value=10**9 - 1))
def test_npi_checksum(spark, nine):
    digits = f"80840{nine}"
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    npi = f"{nine}{-total % 10}"
    assert one(spark, text.valid_npi(F.col("v0")), npi)
    wrong = f"{nine}{(-total + 1) % 10}"
    assert not one(spark, text.valid_npi(F.col("v0")), wrong)


@relaxed
@given(st.text(max_size=40))
def test_hmac_and_uuid5(spark, name):
    got = spark.createDataFrame([(name,)], "v string").select(hashing.hmac_sha256(F.col("v"), "key"), hashing.uuid5(uuid.NAMESPACE_DNS.hex, F.col("v")), hashing.whole_digest_bucket(F.col("v"))).first()
    assert got[0] == hmac.new(b"key", name.encode(), hashlib.sha256).hexdigest()
    assert got[1] == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert got[2] == int(hashlib.sha256(name.encode()).hexdigest(), 16) % 100


def test_small_text_rules(spark):
    assert one(spark, text.picture_length(F.col("v0")), "X(10)9(4)V99") == 16
    assert one(spark, text.normalize_checkbox(F.col("v0")), " [x] ") is True and one(spark, text.normalize_checkbox(F.col("v0")), "?") is None
    assert one(spark, text.character_error_rate(F.col("v0"), F.col("v1")), "", "x") == 1.0 and one(spark, text.character_error_rate(F.col("v0"), F.col("v1")), "ab", "ac") == 0.5
    assert one(spark, text.engine_family(F.col("v0")), "RapidOCR-2") == "paddle"
    assert one(spark, sequence_ratio("v0", "v1"), "abcd", "bcde") == 0.75
    assert one(spark, compatible_form("v0"), "ﬁ") == "fi"


def test_number_rules(spark):
    assert one(spark, numbers.wilson(F.col("v0"), F.col("v1"), True), 0, 0) is None and one(spark, numbers.wilson(F.col("v0"), F.col("v1"), False), 0, 0) == 0.0
    assert one(spark, numbers.defined_rate(F.col("v0"), F.col("v1")), 1, 0) is None and one(spark, numbers.rate(F.col("v0"), F.col("v1")), 1, 0) == 0.0
    assert one(spark, numbers.weighted_mean([(F.col("v0"), 0.5), (F.lit(None).cast("double"), 0.5)]), 0.8) == pytest.approx(0.8)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(1000, 1060), 1000), 7: 7, 8: 7}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_vote_needs_a_majority(spark):
    rows = [(1, "a", "x", 0), (1, "a", "y", 1), (1, "b", "x", 2), (2, "a", "x", 0), (2, "b", "x", 1), (3, None, "x", 0)]
    got = {r.k: r.winner for r in ranking.vote(spark.createDataFrame(rows, "k int, v string, s string, o int"), ["k"], "v", "s", "o", 1).collect()}
    assert got == {1: "a", 2: None}


def test_hamming_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(8)]
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]
    got = {(r.a, r.b): r.distance for r in joins.hamming_pairs(spark.createDataFrame(signed, "k long, v long"), "k", "v", 4).collect()}
    first = {v: i for i, v in reversed(list(enumerate(values)))}
    ids = sorted(first.values())
    assert got == {(i, j): d for i in ids for j in ids if i < j and (d := (values[i] ^ values[j]).bit_count()) <= 4}


@pytest.mark.parametrize("most", [0, 4, 16, 18, 31, 63, 64])
def test_hamming_pairs_of_any_distance(spark, most):
    """Also pairs that differ in every nibble, when bands are narrower than one."""
    values = [0, 0x1111111111111111, 0x1111111111111117, 0x7FFFFFFFFFFFFFFF, -1]
    want = {(i, j): d for j in range(5) for i in range(j) if (d := ((values[i] ^ values[j]) & (2**64 - 1)).bit_count()) <= most}
    assert {(r.a, r.b): r.distance for r in joins.hamming_pairs(spark.createDataFrame(list(enumerate(values)), "k long, v long"), "k", "v", most).collect()} == want


@relaxed
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 50)), min_size=1, max_size=40), st.integers(1, 20))
def test_largest_remainder_adds_up(spark, rows, target):
    df = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(rows)], "s string, i long")
    out = governance.stratified_sample(df, "s", "i", target, "seed").collect()
    assert len(out) == min(target, len(rows)) and len({r.i for r in out}) == len(out)


def test_splits_do_not_depend_on_row_order(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in governance.ranked_split(df.repartition(7), "k", "s", 0.3).collect()}
    b = {r.k: r.split for r in governance.ranked_split(df.orderBy(F.desc("k")), "k", "s", 0.3).collect()}
    assert a == b and sum(v == "DEVELOPMENT" for v in a.values()) == 150


def test_chain_detects_tampering(spark):
    e = spark.createDataFrame([(1, k, f"p{k}") for k in range(5)], "l int, o long, p string")
    links = governance.chain(e, "l", "o", F.col("p")).join(e, ["l", "o"])
    assert governance.verify_chain(links, "l", "o", F.col("p")).first().broken == 0
    assert governance.verify_chain(links.withColumn("p", F.when(F.col("o") == 2, "other").otherwise(F.col("p"))), "l", "o", F.col("p")).first().broken == 1
    assert governance.verify_chain(links.filter("o <> 2"), "l", "o", F.col("p")).first().broken == 1


@relaxed
@given(st.integers(0, 10**6 - 1), st.text("ABC xyz", max_size=12))
def test_fixed_width_round_trip(spark, number, word):
    fields = [fw.Field("n", 1, 6, "NUMERIC"), fw.Field("w", 9, 12)]
    df = spark.createDataFrame([(number, word)], "n long, w string").select(fw.render_record(fields, {"n": F.col("n"), "w": F.col("w")}).alias("line"))
    row = df.select("line", fw.parse_record(fields, F.col("line"), 20).alias("p")).first()
    assert len(row.line) == 20 and int(row.p.n) == number and row.p.w == word.strip()


def test_fixed_width_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="more than 3 digits"):
        spark.range(1).select(fw.render_field(fw.Field("n", 1, 3, "NUMERIC"), F.lit(12345))).collect()


def test_rules_and_gates(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    assert {(r.k, r.rule) for r in rules.findings(df, "k", {"POSITIVE": (F.col("v") > 0, "error"), "SMALL": (F.col("v") < 3, "warning")}).collect()} == {(1, "SMALL"), (2, "POSITIVE"), (2, "SMALL")}
    assert spark.range(1).select(rules.failed_gates({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)})).first()[0] == "B,C"


def test_match_fields_takes_the_last_prediction(spark):
    truth = spark.createDataFrame([(1, "f", "x"), (2, "f", "y")], "d int, n string, t string")
    predicted = spark.createDataFrame([(1, "f", "old", 1), (1, "f", "new", 2), (9, "f", "z", 1)], "d int, n string, p string, o int")
    assert {(r.d, r.p) for r in metrics.match_fields(truth, predicted, ["d", "n"], "o").collect()} == {(1, "new"), (2, None)}


def test_compare_and_set(spark):
    tasks = spark.createDataFrame([(1, 0, "OPEN"), (2, 3, "OPEN"), (3, 1, "DONE")], "t int, version int, status string")
    asked = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (2, 2, "a"), (3, 1, "a"), (4, 0, "a")], "t int, expected_version int, who string")
    new, outcomes = tables.compare_and_set(tasks, asked, "t")
    assert {(r.t, r.who) for r in outcomes.filter("outcome = 'CLAIMED'").collect()} == {(1, "a")} and outcomes.count() == 5
    assert sorted(map(tuple, new.collect())) == [(1, 1, "IN_PROGRESS", "a"), (2, 3, "OPEN", None), (3, 1, "DONE", None)]


def test_retention_deletes_what_is_below_too(spark):
    docs = spark.createDataFrame([(1, "2020-01-01"), (2, "2024-01-01"), (3, None)], "d int, at string").withColumn("at", F.col("at").cast("timestamp"))
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "d int, p int")
    kept, left, audit = tables.retention_sweep(docs, pages, "d", "at", F.lit("2024-02-01").cast("timestamp"), 365)
    assert {r.d for r in kept.collect()} == {2, 3} and left.count() == 1 and [r.d for r in audit.collect()] == [1]


def test_append_refuses_contradictions(spark):
    have = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c"), (3, "x"), (3, "y")], "k int, v string")
    table, rejected = tables.append_checked(have, new, "k", "v")
    assert sorted(map(tuple, table.collect())) == [(1, "a"), (2, "c")] and {r.k for r in rejected.collect()} == {1, 3}


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.tif").write_bytes(b"II*\0data")
    (tmp_path / "c.bin").write_bytes(b"?")
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in files.file_inventory(spark, str(tmp_path)).collect()} == {"a.pdf": "PDF", "b.tif": "TIFF", "c.bin": "UNKNOWN"}
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": oops}\n{"a": 2}\n')
    assert files.json_lines(spark, str(lines), "a int", strict=False).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, str(lines), "a int", strict=True).collect()
    tsv = spark.createDataFrame([("5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t96.5\tword",), ("4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t",)], "line string")
    assert [(r.text, r.conf) for r in files.word_table(tsv, "line").collect()] == [("word", 96.5)]


def test_workbook_source(spark, tmp_path):
    book = tmp_path / "b.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>code</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row><row><c r="B3"><v>8</v></c></row>'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    spark.dataSource.register(files.WorkbookSource)
    df = spark.read.format("workbook").schema("name string, code string").option("path", str(book)).load()
    assert sorted(map(tuple, df.collect()), key=str) == [("Ann", "7"), (None, "8")]


def test_staged_tables_and_their_folder(spark):
    from claimweave.sources import staging

    class Cluster:
        """A session of a cluster without a shared folder."""

        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: Cluster)

    Cluster.getCheckpointDir = staticmethod(lambda: type("None_", (), {"isEmpty": staticmethod(lambda: True)}))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(Cluster)
    assert staging.staged(spark.range(3), "three").count() == 3
