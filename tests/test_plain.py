"""Queries that SQL can't express, against plain Python over the whole tables."""

from __future__ import annotations

import difflib
import hashlib
import hmac
import re
import statistics

import pytest

from claimweave.plans import catalogue


def run(spark, small_dir, name):
    return catalogue.queries()[name](spark, small_dir).collect()


def ratio(phrase: str, text: str) -> float:
    """The phrase in the text, or the best of all runs of as many words."""
    if phrase in text:
        return 1.0
    words, n = text.split(), max(1, len(phrase.split()))
    windows = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    return max((difflib.SequenceMatcher(None, w, phrase).ratio() for w in windows), default=0.0)


def lines_of(tokens: list[tuple]) -> dict:
    """ord to (line, place): tokens (ord, x0, y0, y1) down the page, each to the line whose mean centre is nearest, if it is near."""
    limit = 0.55 * statistics.median(y1 - y0 for _, _, y0, y1 in tokens)
    lines: list[list] = []
    for t in sorted(tokens, key=lambda t: ((t[2] + t[3]) / 2, t[1], t[0])):
        c = (t[2] + t[3]) / 2
        near = min(lines, key=lambda own: abs(sum((a[2] + a[3]) / 2 for a in own) / len(own) - c), default=None)
        if near is not None and abs(sum((a[2] + a[3]) / 2 for a in near) / len(near) - c) <= limit:
            near.append(t)
        else:
            lines.append([t])
    lines.sort(key=lambda own: sum((a[2] + a[3]) / 2 for a in own) / len(own))
    out, place = {}, 0
    for k, own in enumerate(lines):
        for t in sorted(own, key=lambda t: (t[1], t[0])):
            out[t[0]] = (k, place)
            place += 1
    return out


def boxes(spark, small_dir) -> dict:
    """conv_id to tokens (ord, x0, y0, y1, word, turn)."""
    out: dict = {}
    for r in spark.read.parquet(f"{small_dir}/conversations.parquet").collect():
        for pos, word in enumerate(r.text.split(" ")):
            y = r.turn * 100000.0 + pos // 5 * 12.0 + pos % 3 * 1.5
            out.setdefault(r.conv_id, []).append((r.turn * 100000 + pos, pos % 5 * 50.0, y, y + 9, word, r.turn))
    return out


def test_reading_order(spark, small_dir):
    got: dict = {}
    for r in run(spark, small_dir, "reading_order"):
        got.setdefault(r.conv_id, {})[r.ord] = (r.line, r.place)
    for page, tokens in boxes(spark, small_dir).items():
        want = lines_of([t[:4] for t in tokens])
        first = min(v[1] for v in got[page].values())
        assert {o: (line, place - first) for o, (line, place) in got[page].items()} == want


def test_region_text(spark, small_dir):
    want = {}
    for page, tokens in boxes(spark, small_dir).items():
        for turn in {t[5] for t in tokens}:
            own = [t for t in tokens if t[5] == turn and t[1] + 40 <= 100 and t[2] - turn * 100000 < 5]
            order = lines_of([t[:4] for t in own])
            rows = len({line for line, _ in order.values()})
            want[f"{page}-{turn}"] = (rows, " ".join(t[4] for t in sorted(own, key=lambda t: order[t[0]][1])) if rows == 1 else None)
    assert {r.page: (r.rows, r.value) for r in run(spark, small_dir, "region_text")} == want


def test_family_router(spark, small_dir):
    anchors = {"greeting": ["good morning to you", "thanks for the help"], "question": ["what is the", "how do i"], "statement": ["this is a", "there are many"]}
    want = {}
    for r in spark.read.parquet(f"{small_dir}/conversations.parquet").collect():
        scores = {f: [ratio(p, r.text.lower()) for p in ps] for f, ps in anchors.items()}
        best = min((-min(1.0, max(x) + 0.12 * min(2, sum(v >= 0.55 for v in x))), f) for f, x in scores.items())
        want[f"{r.conv_id}-{r.turn}"] = (best[1] if best[0] <= -0.7 else "REVIEW", pytest.approx(-best[0]))
    assert {r.page: (r.route, r.score) for r in run(spark, small_dir, "family_router")} == want


def test_label_detections(spark, small_dir):
    aliases = [("cause", "because of"), ("question", "what is"), ("question", "how do"), ("thanks", "thank you"), ("article", "the")]
    want = {}
    for r in spark.read.parquet(f"{small_dir}/conversations.parquet").collect():
        low = re.sub("[^A-Za-z0-9 ]", " ", r.text).strip(" ").lower()
        held = [(f, a, 1.0) for f, a in aliases if a in low] if low else []
        near = [(f, a, x) for f, a in aliases for x in [ratio(a, low)] if x >= 0.84] if low and not held else []
        for f, a, x in (held or near)[:1]:
            want[r.conv_id, r.turn] = (f, a, pytest.approx(x))
    assert {(r.conv_id, r.turn): (r.field, r.alias, r.similarity) for r in run(spark, small_dir, "label_detections")} == want and want


def test_fuzzy_reference_match_blocks(spark, small_dir):
    people = spark.read.parquet(f"{small_dir}/customer.parquet").collect()
    want = {}
    for a in (p for p in people if p.c_custkey % 2 == 0):
        pairs = [(-difflib.SequenceMatcher(None, a.c_name, b.c_name).ratio(), b.c_custkey) for b in people if b.c_custkey % 2 and (b.c_nationkey, b.c_mktsegment) == (a.c_nationkey, a.c_mktsegment)]
        if pairs:
            want[a.c_custkey] = (min(pairs)[1], pytest.approx(-min(pairs)[0]), min(pairs)[0] <= -0.92)
    assert {r.member: (r.reference, r.similarity, r.verified) for r in run(spark, small_dir, "fuzzy_reference_match_blocks")} == want and want


def test_keyed_fingerprint_overlap(spark, small_dir):
    sides: dict = {}
    for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "source").collect():
        sides.setdefault(r.source, set()).add(r.doc_id % 3 == 0)
    want = {hmac.new(b"overlap-key", s.encode(), hashlib.sha256).hexdigest() for s, x in sides.items() if len(x) == 2}
    assert {r.fingerprint for r in run(spark, small_dir, "keyed_fingerprint_overlap")} == want and want
