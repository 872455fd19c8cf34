"""Routing rates against plain counting, the route registry, and verified members and providers."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from claimweave.operators import routing

FAMILIES = ["CMS1500", "UB04", "CUSTOM_A", "CLAIM_SUPPORT", "NON_CLAIM", "UNKNOWN_X"]
PREDICTED = ["CMS1500", "UB04", "UNKNOWN_STRUCTURED", "NON_CLAIM", "CUSTOM_A"]
ROUTES = ["CMS_STANDARD_EXTRACTOR", "UB_STANDARD_EXTRACTOR", "LAYOUT_STRUCTURED_EXTRACTOR", "UNSTRUCTURED_EXTRACTOR", "STOP_NON_CLAIM", "SAFE_UNKNOWN"]
STANDARD, FIXED = FAMILIES[:2], ROUTES[:2]


def part(rows, of, among=lambda r: True):
    kind = [r for r in rows if among(r)]
    return sum(map(of, kind)) / len(kind) if kind else 0.0


def test_benchmark_rates(spark):
    r = random.Random(1)
    names = ["t", "p", "top", "er", "r", "calls", "cloud", "ms", "src", "q"]
    rows = [(r.choice(FAMILIES), r.choice(PREDICTED), r.choice(["CLAIM", "NON_CLAIM", "UNKNOWN"]), r.choice(ROUTES), r.choice(ROUTES), r.randint(0, 3), r.randint(0, 1), r.randint(1, 50), r.choice("ab"), r.choice("xyz")) for _ in range(300)] + [("UB04", "CMS1500", "CLAIM", "SAFE_UNKNOWN", "SAFE_UNKNOWN", 1, 0, 9, "lone", None)]
    out = routing.benchmark_rates(spark.createDataFrame(rows, names), "t", "p", "top", "er", "r", "calls", "cloud", "ms", [["src"], ["q"]]).collect()
    dicts = [dict(zip(names, x, strict=True)) for x in rows]
    assert len(out) == 1 + 3 + 4
    for got in out:
        by = {3: None, 1: "src", 2: "q"}[got.grouping]
        own = [x for x in dicts if by is None or x[by] == got[by]]
        ms = sorted(x["ms"] for x in own)
        top = {"CMS1500": "CLAIM", "UB04": "CLAIM", "CUSTOM_A": "CLAIM", "UNKNOWN_X": "UNKNOWN"}
        want = {
            "documents": len(own), "family_accuracy": part(own, lambda x: x["t"] == x["p"]), "top_level_accuracy": part(own, lambda x: top.get(x["t"], x["t"]) == x["top"]), "route_accuracy": part(own, lambda x: x["r"] == x["er"]), "nomination_precision": part(own, lambda x: x["t"] in STANDARD, lambda x: x["p"] in STANDARD),
            "nomination_recall": part(own, lambda x: x["t"] == x["p"], lambda x: x["t"] in STANDARD), "UB04_precision": part(own, lambda x: x["t"] == "UB04", lambda x: x["p"] == "UB04"), "CMS1500_recall": part(own, lambda x: x["p"] == "CMS1500", lambda x: x["t"] == "CMS1500"),
            "custom_recognition": part(own, lambda x: x["p"] in PREDICTED[:3], lambda x: x["t"] == "CUSTOM_A"), "support_compatibility": part(own, lambda x: x["r"] in ROUTES[2:4], lambda x: x["t"] == "CLAIM_SUPPORT"), "non_claim_recall": part(own, lambda x: x["p"] == "NON_CLAIM", lambda x: x["t"] == "NON_CLAIM"),
            "unknown_compatibility": part(own, lambda x: x["r"] in (*ROUTES[2:4], ROUTES[5]), lambda x: x["t"] == "UNKNOWN_X"), "false_standard": sum(x["t"] not in STANDARD and x["r"] in FIXED for x in own), "false_standard_rate": part(own, lambda x: x["r"] in FIXED, lambda x: x["t"] not in STANDARD),
            "CMS1500_to_UB04": part(own, lambda x: x["r"] == FIXED[1], lambda x: x["t"] == "CMS1500"), "safe_fallback_rate": part(own, lambda x: x["t"] == x["p"] and x["r"] == ROUTES[2], lambda x: x["t"] in STANDARD), "calls_per_page": sum(x["calls"] for x in own) / len(own), "cloud_calls": sum(x["cloud"] for x in own),
            "p50": ms[math.ceil(0.5 * len(ms)) - 1], "p95": ms[math.ceil(0.95 * len(ms)) - 1], "p99": ms[math.ceil(0.99 * len(ms)) - 1], "mean_latency": sum(ms) / len(ms),
        }
        assert {k: round(float(got[k]), 12) for k in want} == {k: round(float(v), 12) for k, v in want.items()}
    empty = routing.benchmark_rates(spark.createDataFrame(rows[:1], names).limit(0), "t", "p", "top", "er", "r", "calls", "cloud", "ms", []).first()
    assert (empty.documents, empty.family_accuracy, empty.p50, empty.calls_per_page) == (0, 0.0, None, 0.0)


def test_outcome_rates_and_risk(spark):
    cases = [
        ("EOB", "EOB", "CMS_STANDARD_EXTRACTOR", 100), ("CMS1500", "UB04", "UB_STANDARD_EXTRACTOR", 80), ("UB04", "UB04", "CMS_STANDARD_EXTRACTOR", 80), ("EOB", "EOB", "SAFE_UNKNOWN", 40), ("CMS1500", "CMS1500", "LAYOUT_STRUCTURED_EXTRACTOR", 40), ("EOB", "LAB_REPORT", "LAYOUT_STRUCTURED_EXTRACTOR", 5), ("CMS1500", "CMS1500", "CMS_STANDARD_EXTRACTOR", 0), ("COVER_PAGE", "COVER_PAGE", "STOP_NON_CLAIM", 0),
    ]
    extra = [(False, None, None, None), (False, "VERIFIED", "UB04", None), (False, "VERIFIED", "UB04", None), (True, None, None, "SAFE_UNKNOWN"), (False, "AMBIGUOUS", None, None), (True, None, None, None), (False, "VERIFIED", "CMS1500", None), (False, None, None, None)]
    df = spark.createDataFrame([(*c, *e) for c, e in zip(cases, extra, strict=True)], "t string, p string, r string, want int, a boolean, s string, f string, g string")
    none = F.lit(None).cast("string")
    assert all(x.risk == x.want for x in df.select("want", routing.routing_risk(F.col("t"), F.col("p"), F.col("r"), none).alias("risk")).collect())
    got = routing.outcome_rates(df, *(F.col(c) for c in ("t", "p", "r", "a", "s", "f", "g"))).first().asDict()
    want = {
        "documents": 8, "class_accuracy": 6 / 8, "route_accuracy": 4 / 8, "false_standard_rate": 1 / 4, "CMS1500_false_rate": 1 / 4, "UB04_false_rate": 0.0, "misroute_rate": 2 / 4, "CMS1500_to_UB04": 1 / 3, "UB04_to_CMS1500": 1.0, "unverified_rate": 2 / 8, "safe_fallback_rate": 1 / 4, "CMS1500_safe_fallback_rate": 1 / 3, "UB04_safe_fallback_rate": 0.0,
        "abstention_rate": 2 / 8, "accuracy_not_abstained": 5 / 6, "mean_risk": (100 + 80 + 80 + 0 + 40 + 5) / 8,
    }
    assert got == want
    assert set(routing.outcome_rates(df.limit(0), *(F.col(c) for c in ("t", "p", "r", "a", "s", "f", "g"))).first()) == {0}


def test_route_registry(spark):
    rows = [(1, "r1", "npi", "npi", "cms1500", "SHADOW", None, None, 1, 0), (2, "r2", "npi", "npi", "*", "PRODUCTION_APPROVED", "a", "2024", 1, 0), (3, "r3", "npi", "npi", "CMS1500", "PRODUCTION_APPROVED", "a", "2024", 1, 0), (4, "r4", "dob", "dob", "UB04", "PRODUCTION_APPROVED", "", "2024", 1, 0), (5, "r4", "dob", "date", "*", "DISABLED", None, None, -1, 0), (6, "r6", "dob", "dob", "*", "ODD", None, None, 1, 0)]
    routes = spark.createDataFrame(rows, "position int, route_id string, key string, field string, form string, status string, approved_by string, approved_at string, sample_count int, false_agreement_count int")
    asked = spark.createDataFrame([(1, "npi", "CMS1500"), (2, "npi", "ub04"), (3, "dob", "ub04"), (4, "dob", "CMS1500"), (5, "npi", None), (6, None, "UB04")], "i int, f string, family string")
    find = lambda mode: {r.i: r.route_id for r in routing.registered_routes(asked, routes, "f", "family", mode).collect()}
    assert find("runtime") == {1: "r2", 2: "r2", 3: "r4", 4: None, 5: "r2", 6: None} and find("shadow") == {1: "r1", 2: None, 3: None, 4: None, 5: None, 6: None}
    assert find("evaluation")[1] == "r1" and find(None)[4] == "r6"
    faults = sorted(tuple(r) for r in routing.route_faults(routes).collect())
    assert faults == [("r4", "APPROVAL_WITHOUT_PROVENANCE"), ("r4", "COUNT_NOT_VALID"), ("r4", "DUPLICATE_ROUTE_ID"), ("r4", "KEY_FIELD_MISMATCH"), ("r6", "UNKNOWN_STATUS")]


def test_verified_members_and_providers(spark):
    review, yes = "HUMAN_REVIEW_REQUIRED", "REFERENCE_VERIFIED"
    known = spark.createDataFrame([("a", "2000"), ("b", "2000"), ("b", "2000"), ("c", None)], "member_id string, dob string")
    asked = spark.createDataFrame([(1, "a", "2000", 0.92, False), (2, "a", "2000", 0.91, False), (3, "a", "2001", 0.99, False), (4, "a", "2000", 0.99, True), (5, "b", "2000", 0.99, True), (6, "x", "2000", 0.99, False), (7, None, "2000", 0.99, True), (8, "a", "", 0.99, False), (9, "c", "2000", 0.99, None)], "request int, member_id string, dob string, similarity double, contradicted boolean")
    all3 = ["member_id", "dob", "name"]
    assert sorted(tuple(r) for r in routing.verified_members(asked, known).collect()) == [
        (1, yes, all3, []), (2, review, all3, []), (3, review, ["member_id"], []), (4, review, all3, ["ADDRESS_CONTRADICTION"]), (5, review, ["member_id"], ["REFERENCE_NOT_UNIQUE"]), (6, review, ["member_id"], ["REFERENCE_NOT_UNIQUE"]), (7, review, [], ["MISSING_ID_OR_DOB"]), (8, review, [], ["MISSING_ID_OR_DOB"]), (9, review, ["member_id"], []),
    ]
    directory = spark.createDataFrame([("1",), ("2",), ("2",), ("",)], "npi string")
    asked = spark.createDataFrame([(1, "1", 0.92, False), (2, "1", 0.5, False), (3, "1", 0.99, True), (4, "2", 0.99, False), (5, "2", 0.99, True), (6, None, 0.99, None), (7, "", 0.99, False)], "request int, npi string, similarity double, contradicted boolean")
    gone = ["REFERENCE_NOT_UNIQUE_OR_MISSING"]
    assert sorted(tuple(r) for r in routing.verified_providers(asked, directory).collect()) == [(1, yes, ["npi", "name"], []), (2, review, ["npi"], []), (3, review, ["npi"], ["ADDRESS_CONTRADICTION"]), (4, review, [], gone), (5, review, [], ["ADDRESS_CONTRADICTION"]), (6, review, [], gone), (7, review, [], gone)]
