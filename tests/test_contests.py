"""Recovered phrases and conflicts, against plain sequential rules."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from claimweave.operators import conflicts, phrases

PHRASES = {"B": ["type of bill", "principal diagnosis", "units"], "C": ["patients name", "federal tax id", "diagnosis or nature of illness"]}


def fold(word: str) -> str:
    return re.sub("[^a-z]", "", word.lower().translate(str.maketrans("0158", "oisb")))


def plain_phrases(lines: list[tuple]) -> dict:
    """Start by start and word by word."""
    tokens = [(fold(w), line) for line in sorted(lines, key=lambda x: (x[4], x[3], x[1])) for w in re.findall("[A-Za-z0-9]+", line[2])]
    out = {}
    for family, own in PHRASES.items():
        for phrase in own:
            wanted = [fold(w) for w in phrase.split()]
            for start in range(len(tokens)):
                pos, used = start, []
                for word in wanted:
                    for n in range(1, min(4, len(tokens) - pos) + 1):
                        made = "".join(t for t, _ in tokens[pos : pos + n])
                        if made == word or (len(word) >= 5 and sum(a != b for a, b in zip(made, word, strict=False)) + abs(len(made) - len(word)) <= 1):
                            used += tokens[pos : pos + n]
                            pos += n
                            break
                    else:
                        break
                else:
                    box = [f(x[k] for _, x in used) for k, f in ((3, min), (4, min), (5, max), (6, max))]
                    if box[3] - box[1] <= 0.14:
                        out[family, phrase] = ([t for t, _ in used], max(0.75, 1 - 0.05 * sum(t not in wanted for t, _ in used)), *box)
                        break
    return out


def test_phrases_equal_the_plain_search(spark):
    rng = random.Random(5)
    words = "TYPE 0F OF BILL B1LL PRINC IPAL PRINCIPAL DIAGN0 SIS DIAGNOSIS PATIENT S PATIENTS NAME FEDERAL TAX ID 1D OR NATURE ILLNESS UNITS UN1TS 42 x".split()
    rows = []
    for page in range(120):
        y = 0.05
        for k in range(rng.randint(1, 8)):
            rows.append((f"p{page}", k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), round(rng.choice((0.1, 0.5)), 3), round(y, 3), 0.9, round(y + 0.03, 3)))
            y += rng.choice((0.0, 0.04, 0.1))
    for page, text in enumerate(("TYPE OF BILL", "PRINCIPAL|DIAGN0|SIS", "DIAGNOSIS OR NATURE|OF ILLNESS", "TYPE|||||OF BILL", "DIAGNOSIS")):
        rows += [(f"q{page}", k, t, 0.1, 0.1 + 0.04 * k, 0.3, 0.13 + 0.04 * k) for k, t in enumerate(text.split("|"))]
    df = spark.createDataFrame(rows, "page string, ord int, text string, x0 double, y0 double, x1 double, y1 double").repartition(4)
    got: dict = {}
    for r in phrases.recovered_phrases(df, PHRASES).collect():
        got.setdefault(r.page, {})[r.family, r.phrase] = (r.tokens, pytest.approx(r.quality), r.x0, r.y0, r.x1, r.y1)
    pages: dict = {}
    for r in rows:
        pages.setdefault(r[0], []).append(r)
    assert got == {p: w for p, lines in pages.items() if (w := plain_phrases(lines))}
    assert {("q0", "type of bill"), ("q1", "principal diagnosis"), ("q2", "diagnosis or nature of illness")} <= {(p, k[1]) for p, w in got.items() for k in w} and "q3" not in got and "q4" not in got
    assert phrases.recovered_phrases(df, {}).count() == 0 and phrases.recovered_phrases(df.limit(0), PHRASES).count() == 0


def test_texts_that_pass_for_a_word_are_those_of_the_plain_rule():
    for word in ("", "of", "units", "ofofof"):
        tried = {word[:k] + x + word[k + n :] for k in range(len(word) + 1) for n in (0, 1, 2) for x in ("", "a", "z", "of")}
        plain = {m for m in tried if m == word or (len(word) >= 5 and sum(a != b for a, b in zip(m, word, strict=False)) + abs(len(m) - len(word)) <= 1)}
        assert plain == tried & phrases._passing(word) and plain


def test_phrases_of_many_words_are_quick(spark):
    """A token isn't held against every word: the words are looked up."""
    rng = random.Random(2)
    many = {"F": ["".join(rng.choices("abcdefgh", k=9)) for _ in range(1500)]}
    lines = spark.range(2000).select(F.col("id").alias("page"), F.lit(0).alias("ord"), F.concat(F.repeat(F.lit("Other words 5tand here "), 5), F.lit(many["F"][7].upper()), F.lit(" 42")).alias("text"), *(F.lit(x).alias(c) for c, x in (("x0", 0.1), ("y0", 0.1), ("x1", 0.9), ("y1", 0.13))))
    began = time.perf_counter()
    found = phrases.recovered_phrases(lines, many).groupBy("phrase").count().collect()
    assert [tuple(r) for r in found] == [(many["F"][7], 2000)] and time.perf_counter() - began < 60


def sequential(rows: list[tuple]) -> list[tuple]:
    """One conflict at a time, from the first field on."""
    fields: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], -r[3], r[5])):
        fields.setdefault(r[1], []).append(r)
    while True:
        held: dict = {}
        for name in list(fields):
            top = fields[name][0]
            if top[2] not in held:
                held[top[2]] = name
                continue
            other = held[top[2]]
            loser = max((name, other), key=lambda f: (-fields[f][0][3], -fields[f][0][4], f))
            fields[loser].pop(0)
            if not fields[loser]:
                del fields[loser]
            break
        else:
            return sorted(v[0] for v in fields.values())


def test_conflicts_end_as_one_at_a_time(spark):
    """Ties, chains of three and more fields, and fields that lose all they had."""
    rng = random.Random(1)
    rows, n = [], 0
    for page in range(80):
        for field in "abcdefg"[: rng.randint(1, 7)]:
            for _ in range(rng.randint(1, 5)):
                rows.append((page, field, f"box{rng.randint(0, 4)}", rng.choice((0.5, 0.6, 0.7)), rng.choice((0.8, 0.9)), n))
                n += 1
    # a chain: each takes the next one's place
    rows += [(99, f, f"c{k + d}", c, 1.0, n + 10 * k + d) for k, f in enumerate("pqrstu") for d, c in ((0, 0.5 + 0.01 * k), (1, 0.4 + 0.02 * (9 - k)))]
    rows += [(99, "o", "c0", 0.99, 1.0, n + 900)]
    df = spark.createDataFrame(rows, "page int, field string, box string, confidence double, mapping double, id int").repartition(4)
    out = conflicts.resolved_conflicts(df, ["page"], "field", [F.col("box")], [F.col("confidence"), F.col("mapping")], [F.desc("confidence"), F.col("id")])
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted(w for p in {r[0] for r in rows} for w in sequential([r for r in rows if r[0] == p]))
    assert conflicts.resolved_conflicts(df.limit(0), ["page"], "field", [F.col("box")], [F.col("confidence")], [F.col("id")]).count() == 0


def test_candidates_are_moved_once_for_some_rounds(spark, monkeypatch):
    plans, written = [], conflicts.staged
    monkeypatch.setattr(conflicts, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    rows = [(1, f"f{k}", k % 2, 0.5 + k / 10, n) for k in range(4) for n in range(3)] + [(None, "f0", 0, 0.1, 0), (2, None, 0, 0.1, 0)]
    df = spark.createDataFrame(rows, "page long, field string, place long, s double, n long")
    got = conflicts.resolved_conflicts(df, ["page"], "field", [F.col("place")], [F.col("s")], [F.col("n")]).collect()
    assert sorted((r.page, r.field, r.place) for r in got) == [(1, "f2", 0), (1, "f3", 1)]
    assert plans and all(p.count("Exchange hashpartitioning") == 1 and "Join" not in p for p in plans)
