"""The cost governor as a stream, and the sample by quotas, against plain sequential rules."""

from __future__ import annotations

import datetime
import hashlib
import json
import random

from pyspark.sql import functions as F

from claimweave.operators import governance
from claimweave.streaming import governor

SCHEMA = "account long, event_id long, ts timestamp, kind string, page string, claim string, tier string, cost double"


def replayed(rows: list[tuple], limits: governor.Limits) -> dict:
    """One event after the other, as they happened."""
    out, state = {}, {}
    for account, event_id, _, kind, page, claim, tier, cost in sorted(set(rows), key=lambda r: (r[2], r[1])):
        s = state.setdefault(account, {"pages": 0, "cost": 0.0, "calls": {}, "claims": {}})
        if kind == "PAGE":
            s["pages"] += 1
        elif kind == "CALL":
            why = governor.GRANTED
            if s["calls"].get((page, tier), 0) >= limits.page_calls.get(tier, 0):
                why = governor.PAGE_LIMIT
            elif s["claims"].get(claim, 0.0) + limits.estimate > limits.claim_cost:
                why = governor.CLAIM_LIMIT
            elif (s["cost"] + limits.estimate) / max(1, s["pages"]) > limits.mean_cost:
                why = governor.MEAN_LIMIT
            out[event_id] = why
            if why == governor.GRANTED:
                s["calls"][page, tier] = s["calls"].get((page, tier), 0) + 1
                s["cost"] += cost
                s["claims"][claim] = s["claims"].get(claim, 0.0) + cost
    return out


def test_governor_equals_a_replay_in_order(spark, tmp_path):
    """Events in any order within the watermark, sent again, over many micro-batches, with a restart between; late ones are dropped."""
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = []
    for k in range(600):
        kind = rng.choice(("PAGE", "CALL", "CALL", "CALL"))
        page = rng.randint(0, 30)
        rows.append((page % 3, k, start + datetime.timedelta(seconds=k * 10, microseconds=rng.randint(0, 999_999)), kind, f"p{page}", f"c{page % 7}", rng.choice(("TEXT", "CROP")), rng.choice((0.5, 1.0, 2.0))))
    limits = governor.Limits({"TEXT": 4, "CROP": 3}, 9.0, 1.1, 1.0)
    sent = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=rng.uniform(0, 300)))  # up to five minutes late
    batches = [sent[k : k + 100] for k in range(0, 600, 100)]
    for k in range(1, 6):
        batches[k] = batches[k] + rng.sample(batches[k - 1], 30)  # sent again
    close = (0, 10_000, start + datetime.timedelta(days=1), "CLOSE", None, None, None, None)
    too_late = (0, 9_999, start, "CALL", "p0", "c0", "TEXT", 1.0)
    source = tmp_path / "in"
    schema = spark.createDataFrame([], SCHEMA).schema
    before = spark.conf.get(governor.PROVIDER)
    spark.conf.set(governor.PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (batches[:3], [*batches[3:], [too_late], [close]]):  # two runs of one query: the second goes on from the checkpoint
            for rows_of in part:
                spark.createDataFrame(rows_of, schema).coalesce(1).write.mode("append").parquet(str(source))
                stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
            query = governor.governed_stream(stream, limits, "10 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(governor.PROVIDER, before)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("event_id", "granted", "reason").collect()]
    want = replayed(rows, limits)
    assert len(got) == len(want) and {i: why for i, _, why in got} == want and all(g == (why == governor.GRANTED) for _, g, why in got)
    assert set(want.values()) == {governor.GRANTED, governor.PAGE_LIMIT, governor.CLAIM_LIMIT, governor.MEAN_LIMIT}


def greedy(rows: list[tuple[str, str]], targets: dict[str, int], seed: str) -> list[str]:
    """Package by package, counting what has been taken."""
    own: dict = {}
    for package, kind in rows:
        own.setdefault(package, []).append(kind)
    have, taken = dict.fromkeys(targets, 0), []
    for package in sorted(own, key=lambda p: (hashlib.sha256(json.dumps([seed, p], separators=(",", ":")).encode()).hexdigest(), p)):
        if any(have[k] < n and k in own[package] for k, n in targets.items()):
            taken.append(package)
            for kind in own[package]:
                if kind in have:
                    have[kind] += 1
        if all(have[k] >= n for k, n in targets.items()):
            break
    return sorted(taken)


def test_quota_sample_is_the_sequential_one(spark):
    rng = random.Random(2)
    rows = [(f"p{rng.randint(0, 500)}", rng.choice("AAAABBC")) for _ in range(2000)] + [(f"q{k}", "D") for k in range(3)] + [("p1", None), (f'odd"{1}', "C")]
    df = spark.createDataFrame([*rows, (None, "A")], "package string, kind string").repartition(4)
    for targets in ({"A": 50, "B": 200, "C": 5}, {"A": 1}, {"D": 9, "A": 10}, {"C": 0, "B": 3}, {"Z": 4}, {"A": 10_000, "C": 1}, {"B": 0}):
        got = sorted(r.package for r in governance.quota_sample(df, "package", "kind", targets, "seed").collect())
        assert got == greedy(rows, targets, "seed"), targets
    assert governance.quota_sample(df.limit(0), "package", "kind", {"A": 1}, "s").count() == 0
    assert F.col("x") is not None
