"""Fields on pages, against plain Python over all pairs of a page."""

from __future__ import annotations

import datetime
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from claimweave.operators import localization as loc
from claimweave.operators.localization import FieldRule, Relation

SCHEMA = "page string, token string, text string, x0 double, y0 double, x1 double, y1 double, confidence double, line int, place int, ord long, width int, height int"
WORDED = {"PERSON_NAME", "PERSON_OR_ORGANIZATION", "ADDRESS", "TEXT"}


def grade(kind: str, value: str | None) -> float:
    """Type compatibility of the datatypes used here."""
    raw = (value or "").strip()
    digits = re.sub(r"\D", "", raw)
    if not raw:
        return 0.0
    if kind == "NPI":
        return float(len(digits) == 10)
    if kind == "DATE":
        for form in (raw, *((f"{digits[:4]}-{digits[4:6]}-{digits[6:]}", f"{digits[4:]}-{digits[:2]}-{digits[2:4]}") if len(digits) == 8 else ())):
            try:
                return float(bool(datetime.date.fromisoformat(form)))
            except ValueError:
                pass
        return 0.0
    if kind == "CURRENCY":
        return 1.0 if re.fullmatch(r"\$?\d[\d,]*(?:\.\d{1,2})?", raw) else 0.1
    if kind in WORDED:
        return 0.05 if any(w in raw.upper() for w in ("SYNTHETIC", "DOCUMENT", "OFFICIAL FORM", "PATIENT NAME", "PROVIDER NAME", "RELATIONSHIP", "TOTAL CHARGE")) else 0.8 if re.search("[A-Za-z]", raw) else 0.0
    return 0.7


def norm(text: str) -> str:
    return re.sub("[^A-Z0-9 ]", "", text.upper()).replace("1", "I").strip()


def plain_located(tokens: list[dict], rule: FieldRule) -> tuple | None:
    """stage, box, value, score, ownership of one page and rule; every token against every other."""
    width, height = tokens[0]["width"], tokens[0]["height"]
    middle = lambda t: ((t["x0"] + t["x1"]) / 2, (t["y0"] + t["y1"]) / 2)
    found = []
    for t in tokens:
        text = norm(t["text"])
        if not text or t["confidence"] < 0.45 or any(norm(n) and norm(n) in text for n in rule.negatives):
            continue
        x, y = middle(t)
        down = "UPPER" if y / height < 0.4 else "LOWER" if y / height > 0.62 else "MIDDLE"
        across = "LEFT" if x / width < 0.4 else "RIGHT" if x / width > 0.62 else "MIDDLE"
        zone = 1.0 if rule.zone == "ANY" or {down, across} <= set(rule.zone.split("_")) else 0.45
        for k, alias in enumerate(map(norm, rule.aliases)):
            alike = max(SequenceMatcher(None, text, alias).ratio(), SequenceMatcher(None, text[: len(alias)], alias).ratio())
            if alike >= rule.threshold:
                found.append((-alike * (0.8 + 0.2 * zone) * t["confidence"], t["ord"], k, t))
    if not found:
        return ("UNRESOLVED",)
    best = min(found, key=lambda x: x[:3])
    sure, a = -best[0], best[3]
    labels = {norm(x) for x in (*rule.aliases, *rule.negatives)}
    declared = [norm(x) for x in (*rule.negatives, *(n.replace("_", " ") for n in rule.neighbours))]

    def is_label(t: dict) -> bool:
        c = norm(t["text"]).replace(" ", "")
        return not c or any(len(w) >= 3 and (w in c or c in w) for w in (x.replace(" ", "") for x in labels)) or norm(t["text"]) in map(norm, rule.neighbours)

    def declares(t: dict) -> bool:
        return any(x and (x in norm(t["text"]) or norm(t["text"]) in x) for x in declared)

    def reach(t: dict, relation: str) -> float:
        (tx, ty), (ax, ay) = middle(t), middle(a)
        late = 0.012 * max(0, t["place"] - a["place"] - 1)
        if relation == "right_of":
            dx = tx - a["x1"]
            if not (-0.015 * width <= dx <= 0.36 * width and abs(ty - ay) <= 0.055 * height):
                return 0.0
            common = max(0.0, min(t["y1"], a["y1"]) - max(t["y0"], a["y0"]))
            low = min(t["y1"] - t["y0"], a["y1"] - a["y0"])
            s = 0.65 + 0.25 * (common / low if low else 0.0) - 0.35 * max(0, dx) / (0.36 * width)
        else:
            dy, dx = t["y0"] - a["y1"], abs(tx - ax)
            if not (-0.008 * height <= dy <= 0.10 * height and dx <= 0.46 * width):
                return 0.0
            s = 0.95 - 0.5 * max(0, dy) / (0.1 * height) - 0.2 * dx / (0.46 * width)
        return max(0.05, max(0.05, min(1.0, s)) - late)

    def clip(x0: float, y0: float, x1: float, y1: float) -> tuple:
        return max(0, round(x0)), max(0, round(y0)), min(width, round(x1)), min(height, round(y1))

    def around(own: list[dict], relation: str) -> tuple:
        h, right, left = max(t["y1"] - t["y0"] for t in own), max(t["x1"] for t in own), min(t["x0"] for t in own)
        more = {"DATE": 2.25 * h, "CURRENCY": 1.75 * h, "NPI": max(3.75 * h, 0.55 * (right - left))}.get(rule.datatype, max(5.5 * h, 0.9 * (right - left)) if rule.datatype in WORDED else 2.25 * h)
        x0 = left - 0.6 * h
        x0 = max(x0, a["x1"] + 0.1 * h) if relation == "right_of" else x0
        y0, x1, y1 = min(t["y0"] for t in own) - 0.2 * h, right + more, max(t["y1"] for t in own) + 0.8 * h
        for o in tokens:
            if o not in own and declares(o) and o["x0"] >= right and o["y0"] < y1 and o["y1"] > y0:
                x1 = min(x1, o["x0"] - 0.2 * h)
        return clip(x0, y0, x1, y1)

    def worth(**signals: float | None) -> float:
        there = {k: v for k, v in signals.items() if v is not None}
        return min(1.0, sum(dict(rule.weights)[k] * v for k, v in there.items()) / sum(dict(rule.weights)[k] for k in there))

    near = [(t, g, r.name, k) for t in tokens if t is not a and not is_label(t) for k, r in enumerate(rule.relations) if (g := reach(t, r.name)) > 0]
    groups = []
    if rule.datatype in WORDED:
        lines: dict = {}
        for x in near:
            lines.setdefault(x[0]["line"], []).append(x)
        for line in lines.values():
            runs: list = []
            for x in sorted(line, key=lambda x: x[0]["x0"]):
                before = runs[-1][-1][0] if runs else None
                if before and x[0]["x0"] - before["x1"] <= 3.5 * max(1.0, before["y1"] - before["y0"]):
                    runs[-1].append(x)
                else:
                    runs.append([x])
            groups += [([x[0] for x in run[:6]], sum(x[1] for x in run[:6]) / len(run[:6]), max(run[:6], key=lambda x: x[1])[2], "LINE") for run in runs]
    groups += [([t], g, name, "TOKEN") for t, g, name, _ in near]
    seen, candidates = set(), []
    for own, g, name, kind in groups:
        box = around(own, name)
        if box in seen or box[2] <= box[0] or box[3] <= box[1]:
            continue
        seen.add(box)
        value, span = " ".join(t["text"] for t in own).strip(), sum(t["confidence"] for t in own) / len(own)
        cross = None if not declared else 0.0 if any(declares(t) and min(box[2], t["x1"]) > max(box[0], t["x0"]) and min(box[3], t["y1"]) > max(box[1], t["y0"]) for t in tokens) else 1.0
        fit = grade(rule.datatype, value)
        candidates.append({"box": box, "value": value, "ids": {t["token"] for t in own}, "g": g, "span": span, "fit": fit, "cross": cross, "from": "ANCHOR_" + name.upper(), "kind": kind, "score": worth(anchor=sure, geometry=g, span=span, semantic=fit, cross_field=cross)})
    for r in rule.relations:
        box = clip(a["x0"] + r.x0 * width, a["y0"] + r.y0 * height, a["x0"] + r.x1 * width, a["y0"] + r.y1 * height)
        if box[2] <= box[0] or box[3] <= box[1] or box in seen:
            continue
        inside = [t for t in tokens if t is not a and box[0] <= middle(t)[0] <= box[2] and box[1] <= middle(t)[1] <= box[3] and not is_label(t)]
        t = max(inside, key=lambda t: grade(rule.datatype, t["text"]), default=None)
        fit = grade(rule.datatype, t["text"] if t else None)
        candidates.append({"box": around([t], r.name) if t and fit >= 0.5 else box, "value": t["text"] if t else None, "ids": {t["token"]} if t else set(), "g": 0.65, "span": t["confidence"] if t else 0.0, "fit": fit, "cross": None, "from": "CONTRACT", "kind": "CONTRACT", "score": worth(anchor=sure, geometry=0.65, span=t["confidence"] if t else 0.0, semantic=fit)})
    if not candidates:
        return ("ANCHOR_FOUND",)
    candidates.sort(key=lambda c: -round(c["score"], 12))
    top = candidates[0]
    rival = next((c for c in candidates[1:] if norm(c["value"] or "") != norm(top["value"] or "") and not c["ids"] & top["ids"] and c["from"] == top["from"] and c["fit"] >= 0.75), None)
    least = 0.025 if rule.datatype in ("DATE", "PERSON_NAME", "PERSON_OR_ORGANIZATION") else 0.005
    text = lambda s: re.sub("[^A-Z0-9 ]", "", s.upper()).strip()
    inside = [t for t in tokens if top["box"][0] <= middle(t)[0] <= top["box"][2] and top["box"][1] <= middle(t)[1] <= top["box"][3]]
    meets = lambda t, names: any(text(n) and (text(n) in text(t["text"]) or text(t["text"]) in text(n)) for n in names)
    if top["kind"] == "CONTRACT" and not top["ids"]:
        owner = "UNKNOWN"
    elif any(meets(t, (*rule.negatives, *(n.replace("_", " ") for n in rule.neighbours))) for t in inside):
        owner = "WRONG_NEIGHBOR"
    elif any(meets(t, rule.aliases) for t in inside):
        owner = "LABEL_CONTAMINATED"
    elif any(t["token"] not in top["ids"] and grade(rule.datatype, t["text"]) >= 0.5 for t in inside):
        owner = "MULTI_FIELD_CROP"
    elif rival and top["score"] - rival["score"] < least:
        owner = "REGION_AMBIGUOUS"
    else:
        owner = "UNKNOWN" if not top["ids"] or top["g"] < 0.5 else "REGION_OWNED"
    wrong = owner in ("WRONG_NEIGHBOR", "LABEL_CONTAMINATED", "MULTI_FIELD_CROP", "REGION_AMBIGUOUS")
    stage = "REGION_GEOMETRY_VALIDATED" if top["kind"] == "CONTRACT" else "VALUE_SEMANTICALLY_VALIDATED" if not wrong and top["fit"] >= 0.5 else "VALUE_SPAN_DETECTED"
    return stage, top["box"], top["value"], round(top["score"], 9), owner


def token_rows(page: str, words: list[tuple], width: int = 1000, height: int = 1200) -> list[tuple]:
    return [(page, f"{page}-{k}", text, float(x0), float(y0), float(x1), float(y1), conf, line, k, k, width, height) for k, (text, x0, y0, x1, y1, conf, line) in enumerate(words)]


NEIGHBOURS = [
    ("DATE", "01/02/1980", "03/04/1981"), ("NPI", "1234567890", "1098765432"), ("CURRENCY", "125.00", "999.00"), ("ICD_CODE", "A12.3", "B45.6"), ("CPT_HCPCS", "99213", "A0428"), ("TYPE_OF_BILL", "131", "111"),
    ("TAX_IDENTIFIER", "123456789", "987654321"), ("ALPHANUMERIC_ID", "AB12345", "CD98765"), ("PERSON_NAME", "JANE SMITH", "JOHN BROWN"), ("PERSON_OR_ORGANIZATION", "JANE CLINIC", "JOHN HEALTH"),
]


def test_a_valid_neighbour_does_not_take_the_region(spark):
    rows, rules = [], []
    for datatype, own, other in NEIGHBOURS:
        rows += token_rows(datatype, [("TARGET FIELD", 100, 100, 260, 125, 0.99, 0), (own, 100, 145, 230, 170, 0.98, 1), (other, 560, 145, 700, 170, 0.99, 1)])
        rules.append(FieldRule(datatype, datatype, ("TARGET FIELD",), (Relation("below", 0, 0.01, 0.3, 0.08),)))
    out = {r.page: r for r in loc.located_fields(spark.createDataFrame(rows, SCHEMA), rules).filter("page = field").collect()}
    for datatype, own, _ in NEIGHBOURS:
        row = out[datatype]
        assert (row.value, row.ownership, row.wrong_crop, row.source.split("_")[1]) == (own, "REGION_OWNED", False, "BELOW")


RULES = [
    FieldRule("patient_name", "PERSON_NAME", ("PATIENT NAME", "NAME OF PATIENT"), (Relation("right_of", 0.15, -0.01, 0.5, 0.03), Relation("below", 0, 0.01, 0.3, 0.08)), neighbours=("birth_date",), negatives=("PROVIDER NAME",)),
    FieldRule("birth_date", "DATE", ("BIRTH DATE", "DATE OF BIRTH"), (Relation("below", 0, 0.01, 0.3, 0.08),), zone="UPPER_LEFT", negatives=("SERVICE DATE",)),
    FieldRule("npi", "NPI", ("NPI", "PROVIDER NPI"), (Relation("right_of", 0.02, -0.02, 0.2, 0.03),)),
    FieldRule("total", "CURRENCY", ("TOTAL CHARGE",), (Relation("right_of", 0.02, -0.02, 0.2, 0.03), Relation("below")), zone="LOWER_RIGHT", neighbours=("npi",)),
]


def random_page(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words, at = [], 0
    pool = ["PATIENT NAME", "PATIENT NAMF", "NAME OF PAT1ENT", "BIRTH DATE", "B1RTH DATE", "DATE OF BIRTH", "SERVICE DATE", "NPI", "PROVIDER NPI", "PROVIDER NAME", "TOTAL CHARGE", "JANE", "SMITH", "ANN LEE", "01/02/1980", "2020-02-30", "1234567890", "99", "$125.00", "1,200.5", "x", "", "--", "CLINIC"]
    for line in range(rng.randint(3, 9)):
        x, y = rng.randint(10, 200), 60 + line * rng.choice((30, 60, 110)) + rng.randint(-4, 4)
        for _ in range(rng.randint(1, 6)):
            text = rng.choice(pool)
            wide, tall = 8 * max(2, len(text)) + rng.randint(0, 20), rng.randint(12, 26)
            words.append((text, x, y, x + wide, y + tall, round(rng.uniform(0.4, 1), 3), line))
            x += wide + rng.randint(4, 160)
            at += 1
    return words


def test_located_fields_equal_all_pairs(spark):
    pages = {f"p{k}": token_rows(f"p{k}", random_page(k)) for k in range(60)}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = {(r.page, r.field): r for r in loc.located_fields(spark.createDataFrame([t for p in pages.values() for t in p], SCHEMA).repartition(5), RULES).collect()}
    assert len(out) == len(pages) * len(RULES)
    stages, owners = set(), set()
    for page, rows in pages.items():
        for rule in RULES:
            want, got = plain_located([dict(zip(names, t, strict=True)) for t in rows], rule), out[page, rule.field]
            assert got.stage == want[0], (page, rule.field, want, got)
            stages.add(got.stage)
            if len(want) > 1:
                owners.add(got.ownership)
                assert ((got.x0, got.y0, got.x1, got.y1), got.value, round(got.score, 9), got.ownership) == want[1:], (page, rule.field, want, got)
    assert stages >= {"UNRESOLVED", "REGION_GEOMETRY_VALIDATED", "VALUE_SEMANTICALLY_VALIDATED", "VALUE_SPAN_DETECTED"} and owners >= {"REGION_OWNED", "WRONG_NEIGHBOR", "MULTI_FIELD_CROP", "UNKNOWN"}


def test_close_labels_lose_nothing_to_the_bound(spark):
    rng = random.Random(3)
    labels = [(str(k), "".join(rng.choice("ABEINT ") for _ in range(rng.randint(3, 12))).strip() or "X", 0.72) for k in range(12)]
    texts = sorted({"".join(rng.choice("ABEINTX  ") for _ in range(rng.randint(1, 16))).strip() for _ in range(300)} - {""})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {(r.t, r.label): r.similarity for r in loc.close_labels(df, "t", labels).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {(t, k): max(ratio(t, name), ratio(t[: len(name)], name)) for t in texts for k, (_, name, _) in enumerate(labels)}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.72} and got


def test_located_fields_of_no_tokens(spark):
    assert loc.located_fields(spark.createDataFrame([], SCHEMA), RULES).count() == 0
    assert [r.stage for r in loc.located_fields(spark.createDataFrame(token_rows("p", [("NOTHING", 1, 1, 5, 5, 0.9, 0)]), SCHEMA), RULES[:1]).collect()] == ["UNRESOLVED"]
    assert spark.createDataFrame([(" ab-1 c ",)], "t string").select(loc.normal(F.col("t"))).first()[0] == "ABI C"


def test_name_regions(spark):
    """One line of the zone, from left to right; labels and numbers aren't names."""
    width, height = 1000, 1000
    words = [
        ("PATIENT'S NAME", 60, 101, 160, 109, 0.9, 0), ("SMITH", 160, 108, 220, 124, 0.8, 1), ("JANE", 60, 109, 120, 125, 0.6, 1), ("123", 230, 108, 260, 124, 0.9, 1), ("A1B", 262, 108, 280, 124, 0.9, 1), ("OTHER", 60, 124, 120, 134, 0.9, 2), ("FAR", 700, 108, 800, 124, 0.9, 1), ("ABC1", 270, 112, 290, 120, 1.0, 1),
    ]
    tokens = spark.createDataFrame(token_rows("p", words, width, height) + token_rows("q", [("x", 900, 900, 910, 910, 1.0, 0)], width, height), SCHEMA)
    zones = spark.createDataFrame([("F", "patient", 0.04, 0.10, 0.30, 0.13)], "form string, field string, x0 double, y0 double, x1 double, y1 double")
    asked = spark.createDataFrame([("p", "F", "patient"), ("q", "F", "patient"), ("p", "G", "patient"), ("p", "F", "other")], "page string, form string, field string")
    out = loc.name_regions(tokens, asked, zones).collect()
    assert sorted((r.page, r.field, r.value, r.outcome, r.reason) for r in out if r.value) == [("p", "patient", "JANE SMITH ABC1", "CROP_SAFE", "STANDARD_ZONE_TOKEN_GEOMETRY")]
    assert sorted((r.page, r.outcome) for r in out if not r.value) == [("p", "LOCALIZATION_UNCERTAIN"), ("p", "LOCALIZATION_UNCERTAIN"), ("q", "EMPTY_CROP")]
    assert next(r for r in out if r.value).confidence == pytest.approx((0.6 + 0.8 + 1.0) / 3)
