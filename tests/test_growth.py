"""Work that follows the input: the same results as the plain way, at sizes or on rows where the plain way is too slow."""

from __future__ import annotations

import datetime
import difflib
import random
import statistics
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimweave.functions import similarity
from claimweave.functions.similarity import _edits, edit_distance
from claimweave.operators import joins, layout, localization
from claimweave.plans import catalogue
from claimweave.streaming import governor, jobs


def test_edit_distance_of_any_texts(spark):
    r = random.Random(5)
    texts = ["", "a", "äöü", "x" * 70] + ["".join(r.choices("abcß😀 ", k=r.randrange(90))) for _ in range(40)]
    rows = [(a, b) for b in texts for a in texts[::3]] + [(None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(edit_distance("a", "b").alias("x"), F.levenshtein("a", "b").alias("y")).collect()
    assert all(row.x == row.y for row in got) and got[-1].x is None


def test_edit_distance_of_long_texts_is_quick():
    r = random.Random(1)
    long = "".join(r.choices("abcdefgh ", k=100_000))
    start = time.perf_counter()
    assert _edits(long, {}, long[:1000]) == 99_000
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("like", [joins.BY_EDITS, joins.BY_BLOCKS])
def test_most_similar_names_are_those_of_all_pairs(spark, like):
    r = random.Random(3)
    names = ["", "ab", "aba", "b|0a"] + ["x" + "".join(r.choices("ab0|,", k=r.randrange(1, 9))) for _ in range(90)]
    rows = [(i, f"b{i % 3}", r.choice(names)) for i in range(200)] + [(300, "b1", None), (301, "alone", "ab"), (302, None, "ab")]
    asked, reference = spark.createDataFrame(rows[::2] + [rows[-1]], "id long, block string, name string"), spark.createDataFrame(rows[1::2], "key long, block string, name string").filter("block <> 'alone'")
    pairs = asked.join(reference.withColumnRenamed("name", "other"), "block").withColumn("s", like.similarity(F.col("name"), F.col("other")))
    want = {}
    for p in sorted(pairs.collect(), key=lambda p: (p.s is None, -(p.s or 0), p.key)):
        want.setdefault(p.id, (p.key, p.s))
    assert {x.id: (x.key, x.similarity) for x in joins.most_similar(asked, reference, ["block"], "name", "key", like).collect()} == want


def test_few_names_meet_their_whole_block(spark):
    pairs = spark.sparkContext.accumulator(0)
    count = F.udf(lambda a, b: pairs.add(1) or float(sum(x == y for x, y in zip(a, b, strict=True))) / 8, "double")
    like = joins.Likeness(lambda a, b: count(a, b), lambda size, longest, edits: (size - edits) / size, (1, 2), True)
    c = spark.range(6000).select("id", F.lit(1).alias("block"), F.lpad(F.col("id").cast("string"), 8, "0").alias("name"))
    assert joins.most_similar(c.filter("id % 2 = 0"), c.filter("id % 2 = 1").withColumnRenamed("id", "key"), ["block"], "name", "key", like).count() == 3000
    assert pairs.value < 3000 * 3000 / 20


def test_forms_of_names_are_not_sent_whole(spark, monkeypatch):
    plans, staged = [], joins.staged
    monkeypatch.setattr(joins, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name))
    c = spark.range(400).select("id", F.lit(1).alias("block"), F.lpad(F.col("id").cast("string"), 8, "0").alias("name"))
    out = joins.most_similar(c.filter("id % 2 = 0"), c.filter("id % 2 = 1").withColumnRenamed("id", "key"), ["block"], "name", "key", joins.BY_EDITS)
    lookups = [x for p in plans for x in p.splitlines() if "Join" in x and "__form" in x]
    assert lookups and all("SortMergeJoin" in x for x in lookups)
    sent = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    assert all("LeftOuter" in x for x in sent)  # the list of full blocks only


@pytest.mark.parametrize("most", [3, 256])
def test_names_far_from_all_others_meet_their_block_in_parts(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "NAMES", most, raising=False)
    r = random.Random(11)
    rows = [(i, "full" if i % 5 else f"b{i % 7}", "".join(r.choices("abcdefghijklmnop", k=r.randrange(12, 20)))) for i in range(240)] + [(500, "full", None), (501, "full", None)]
    asked, reference = spark.createDataFrame(rows[::2], "id long, block string, name string"), spark.createDataFrame(rows[1::2], "key long, block string, name string")
    pairs = asked.join(reference.withColumnRenamed("name", "other"), "block").withColumn("s", 1 - F.levenshtein("name", "other").cast("double") / F.greatest(F.length("name"), F.length("other")))
    want = {}
    for p in sorted(pairs.collect(), key=lambda p: (p.s is None, -(p.s or 0), p.key)):
        want.setdefault(p.id, (p.key, p.s))
    got = joins.most_similar(asked, reference, ["block"], "name", "key", joins.BY_EDITS).collect()
    assert {x.id: (x.key, x.similarity) for x in got} == want and len(got) == len(want)


def test_all_pairs_of_hashes_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 37)
    r = random.Random(7)
    rows = [(i, r.getrandbits(64) - (1 << 63)) for i in range(300)]
    nulls = [(600, None), (None, 77)]
    rows += [(400 + i, v ^ 5) for i, (_, v) in enumerate(rows[:60])] + [(500, rows[0][1])]
    bits = lambda v: (v + (1 << 64)) % (1 << 64)
    want = {(a, b): (bits(v) ^ bits(w)).bit_count() for a, v in rows[:-1] for b, w in rows[:-1] if a < b and (bits(v) ^ bits(w)).bit_count() <= 22}
    pairs = joins.hamming_pairs(spark.createDataFrame(rows + nulls, "k long, v long"), "k", "v", 22)
    got = pairs.collect()
    assert {(p.a, p.b): p.distance for p in got} == want and len(got) == len(want)
    assert "bits" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # no pair meets in bands


class Store(dict):
    """State of one name, with the calls that were made to it."""

    calls = 0

    def __getattribute__(self, name):
        if not name.startswith("_"):
            Store.calls += 1
        return super().__getattribute__(name)

    def exists(self):
        return bool(self.__len__())

    def get(self):
        return self["whole"]

    def update(self, value):
        self["whole"] = value

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def getValue(self, k):  # noqa: N802
        return self[k] if k in self else None

    def containsKey(self, k):  # noqa: N802
        return k in self

    def removeKey(self, k):  # noqa: N802
        del self[k]

    def iterator(self):
        return iter([*zip(self.__iter__(), map(self.__getitem__, self.__iter__()), strict=True)])

    def keys(self):
        return iter([*self.__iter__()])


def test_governor_calls_its_state_by_batch_page_and_claim():
    timers = []
    handle = SimpleNamespace(getMapState=lambda *a: Store(), getValueState=lambda *a: Store(), registerTimer=lambda at: timers.append(at))
    g = governor.CostGovernor(governor.Limits({"TEXT": 9}, 1e9, 1e9, 0.5))
    g.init(handle)
    n = 5000
    events = pd.DataFrame({"event_id": range(n), "ts": pd.date_range("2024-01-01", periods=n, freq="10s"), "kind": "CALL", "page": [f"p{i % 7}" for i in range(n)], "claim": [f"c{i % 3}" for i in range(n)], "tier": "TEXT", "cost": 1.0})
    list(g.handleInputRows((1,), iter([events.iloc[::2], events.iloc[1::2]]), None))
    out = []
    while timers:
        now = min(timers) + 6 * 3_600_000
        timers[:] = [t for t in timers if t > now]
        out += list(g.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), None))
    got = pd.concat(out)
    assert got["event_id"].tolist() == list(range(n)) and got["granted"].sum() == 63 and got["granted"][:63].all()
    assert Store.calls < n / 5


def test_budgets_of_many_users_share_their_state_row(spark, tmp_path):
    r = random.Random(9)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(i, start + datetime.timedelta(minutes=r.randrange(3000)), r.choice([None, *range(2**60, 2**60 + 300)]), r.random() * 30) for i in range(3000)]
    schema = "event_id long, ts timestamp, user_id long, value double"
    rows.sort(key=lambda x: x[1])
    for k in range(3):
        spark.createDataFrame(rows[k * 1000 : k * 1000 + 1000], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = jobs.event_stream(spark, f"{tmp_path}", 1)
    want, spent = {}, {}
    for i, ts, user, value in sorted(rows, key=lambda x: (x[1], x[0])):
        before = spent.get((user, ts.date()), 0.0)
        want[i] = (user, before + value <= 40)
        if before + value <= 40:
            spent[user, ts.date()] = before + value
    got = jobs.spend_within_budget(stream, 40.0).collect()
    assert {x.event_id: (x.user_id, x.granted) for x in got} == want and len(got) == len(rows)
    assert jobs.SHARES * 30 < 10_000  # groups of a month, however many users there are


def test_frequent_words_of_pages_are_no_single_task(spark):
    word = F.when(F.col("id") % 8 == 0, F.concat(F.lit("w"), F.col("id").cast("string"))).otherwise("the")
    tokens = spark.range(20_000).select(F.floor(F.col("id") / 20).alias("page"), (F.col("id") % 20).cast("string").alias("token"), word.alias("text"), *(F.lit(float(v)).alias(c) for c, v in (("x0", 1), ("y0", 1), ("x1", 9), ("y1", 9), ("confidence", 1))), F.lit(1).alias("line"), F.col("id").alias("place"), F.col("id").alias("ord"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    rules = [localization.FieldRule("f", "OTHER", ("the",), (localization.Relation("below"),), neighbours=("the",), threshold=1.0)]
    for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
        spark.conf.set(c, "-1" if "Join" in c else "false")
    try:
        found, boxes = localization.anchors(tokens, rules), localization._label_boxes(tokens, localization._rule_table(spark, rules))
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (found, boxes)]
        assert found.count() == 1000 and boxes.agg(F.sum(F.size("label_boxes"))).first()[0] == 17_500
        by_text = [line for plan in plans for line in plan.split("\n") if "hashpartitioning(" in line and ("(n#" in line or "__normal#" in line) and "__deal#" not in line and "(__normal#" in line.split("hashpartitioning")[1][:10]]
        assert not [line for line in plans[1].split("\n") if "hashpartitioning(n#" in line] and "__deal#" in plans[0]
        assert len(by_text) <= 1  # the different texts
    finally:
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(c)


def test_best_window_is_that_of_all_windows():
    r = random.Random(4)
    for _ in range(400):
        p, t = (" ".join("".join(r.choices("abcé ", k=r.randrange(1, 6))) for _ in range(r.randrange(n))) for n in (5, 12))
        words, n = t.split(), max(1, len(p.split()))
        want = max((difflib.SequenceMatcher(None, " ".join(words[k : k + n]), p).ratio() for k in range(max(1, len(words) - n + 1))), default=0.0) if words else 0.0
        assert similarity._best_window(p, t) == want
    start = time.perf_counter()
    similarity._best_window("what is the", " ".join("".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(100_000)))
    assert time.perf_counter() - start < 1


def test_reading_order_takes_pages_one_after_the_other(spark):
    r = random.Random(6)
    rows = [(r.choice([None, *range(2**60, 2**60 + 40)]), i, float(r.randrange(9)), y := r.randrange(60) / 4, y + r.choice([1.0, 2.0])) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        tokens = spark.createDataFrame([(p, i, x, y, x + 1, z) for p, i, x, y, z in rows], "page long, ord long, x0 double, y0 double, x1 double, y1 double")
        df = layout.reading_order(tokens, "page")
        got = {x.ord: (x.page, x.line, x.place) for x in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    for page in {p for p, *_ in rows}:
        own = sorted((((y + z) / 2, x, i, z - y) for p, i, x, y, z in rows if p == page))
        limit, lines = 0.55 * statistics.median(h for *_, h in own), []
        for c, x, i, _ in own:  # every token looks at every line
            near = min(lines, key=lambda of: abs(of[0] / of[1] - c), default=None)
            if near is None or abs(near[0] / near[1] - c) > limit:
                near = [0.0, 0, []]
                lines.append(near)
            near[0], near[1] = near[0] + c, near[1] + 1
            near[2].append((x, i))
        lines.sort(key=lambda of: of[0] / of[1])
        flat = [(k, i) for k, of in enumerate(lines) for _, i in sorted(of[2])]
        assert [(page, k, n) for n, (k, _) in enumerate(flat)] == [got[i] for _, i in flat]


def test_readings_are_dealt_however_few_tasks_read_the_cells(spark, small_dir):
    assert catalogue.queries()["cell_readings"](spark, small_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_evidence_is_moved_once_and_families_counted_with_the_best(spark, tmp_path):
    rows = [(1, 5, 7.0, 0.1), (1, 9, 7.0, 0.2), (1, -1, 7.0, 0.0), (1, None, 7.0, 0.3), (2, None, 3.0, 0.01), (2, 4, 4.0, 0.5)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalogue.queries()["evidence_reconcile"](spark, str(tmp_path))
    assert {r.claim_id: (r.value, r.families, r.decision) for r in found.collect()} == {1: (7.0, 2, "ACCEPT"), 2: (4.0, 1, "REVIEW")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
