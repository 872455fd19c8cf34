"""Forms and readings of raw values against plain Python, over made-up readings."""

from __future__ import annotations

import datetime
import random
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import functions as F

from claimweave.functions import dates, fields, readings, text
from claimweave.operators import totals

FORMAT = {"m-d-Y": "%m-%d-%Y", "m/d/Y": "%m/%d/%Y", "m-d-y": "%m-%d-%y", "m/d/y": "%m/%d/%y", "Ymd": "%Y%m%d", "mdY": "%m%d%Y", "mdy": "%m%d%y", "Y-m-d": "%Y-%m-%d"}


def plain_date(value, forms):
    for form in forms:
        try:
            return datetime.datetime.strptime(value, FORMAT[form]).date().isoformat()
        except ValueError:
            continue
    return None


def decimal(value):
    try:
        return Decimal(value).quantize(Decimal("0.01"))
    except InvalidOperation:
        return None


def made_up(seed, n, pieces, most):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, most))) for _ in range(n)]


def over(spark, column, rows, names):
    """The column over rows of texts, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names)).repartition(2)
    return [r.x for r in df.select("i", column.alias("x")).sort("i").collect()]


DATES = ["07-16-2025", "07/16/2025", "07162025", "01 30 26", "07-16-25", "07-16-72", "not a date", "2025-07-16", "071625", "202571", "10101210", "2/29/2023", "2/29/2024", "0000-01-01", "00000101", " 7\t4 2024 ", "12/31/69", "12/31/68", "31/31/1995", "07/ 5/2024", "7- 5-24", "2024-7- 5", "07/ 15/2024", "12122024\n", "", None]


def test_dates_in_the_order_of_formats(spark):
    rows = DATES + made_up(1, 600, list("0123456789012/- ") + ["20", "19", "/", "07", "/ "], 9)
    for forms in (dates.FIELD_FORMATS, dates.EVALUATION_FORMATS, dates.DATATYPE_FORMATS, dates.DIGIT_FORMATS):
        got = over(spark, dates.first_date(F.col("v"), forms).cast("string"), [(v,) for v in rows], ["v"])
        assert got == [None if v is None else plain_date(v, forms) for v in rows]
    got = over(spark, dates.parse_date(F.col("v")).cast("string"), [(v,) for v in rows], ["v"])
    assert got == [None if v is None else plain_date(re.sub(r"\s+", "/", v.strip()), dates.FIELD_FORMATS) for v in rows]
    assert got[:7] == ["2025-07-16", "2025-07-16", "2025-07-16", "2026-01-30", "2025-07-16", "1972-07-16", None]


def plain_money(raw):
    bare, number = raw.strip().strip("|").strip(), re.sub(r"[^0-9.\-]", "", raw)
    return decimal("-" + number if bare.startswith("(") and bare.endswith(")") and number and not number.startswith("-") else number)


MONEY = ["$1,675.00", "175.00", "($80.55)", "($80.55)|", "   ", "| (5) |", "USD 12.345", "12-", "--5", "5.", ".5", "(-3)", "1.2.3", "(.)", "\n(1.005)\t", "||"]


def test_money(spark):
    rows = MONEY + made_up(2, 500, list("0123456789.,$()|- ") + ["12", "00"], 8)
    got = over(spark, text.money(F.col("v")), [(v,) for v in rows], ["v"])
    assert got == [plain_money(v) for v in rows]
    strict = over(spark, text.strict_money(F.col("v")), [(v,) for v in rows], ["v"])

    def plain(v):
        clean = re.sub(r"[$,\s]", "", v)
        return (Decimal(clean).quantize(Decimal("0.01")) if re.fullmatch(r"\d+(\.\d{1,2})?", clean) else None, bool(v.strip()) and clean != v)

    assert [tuple(r) for r in strict] == [plain(v) for v in rows]


def test_checkbox(spark):
    rows = ["X", " [x] ", "yes", "", " ", "[ ]", "no", "Y", "TRUE", "[]", "?", None]
    assert over(spark, text.normalize_checkbox(F.col("v")), [(v,) for v in rows], ["v"]) == [True, True, True, False, False, False, False, None, None, None, None, False]


WORDS = ["07/16/2025", "2025-07-16", "12.50", "(3)", "$1,200", "Doe", "jane", "O'Neil", ",", ".", ":", " ", "  ", "\t", " ", "A1", "j45.9", "99213", "G0101", "-", "0", "00", "007", "|", "é", "1234567893", "123456789", "PO BOX", "|", "/"]


def test_evaluation_and_agreement_forms(spark):
    values = [None, "", " ", *made_up(3, 500, WORDS, 4)]

    def evaluated(v, rule):
        clean = re.sub(r"\s+", " ", v.strip()) if v and v.strip() else None
        if rule == "identifier":
            return re.sub("[^A-Z0-9]", "", v.upper()) if v else None
        if rule in ("digits", "code"):
            return re.sub(r"[^0-9]" if rule == "digits" else "[^A-Z0-9.]", "", (v or "").upper()) or None
        if rule == "date":
            return clean and (plain_date(clean, dates.EVALUATION_FORMATS) or clean)
        if rule == "amount":
            number = re.sub(r"[^0-9.\-]", "", v or "") or None
            d = number and decimal(number)
            return number if d is None else f"{d:f}"
        return clean

    rules = ["text", "identifier", "digits", "code", "date", "amount", "other"]
    rows = [(v, rules[i % 7]) for i, v in enumerate(values * 7)]
    assert len(values) % 7 and over(spark, fields.evaluation_form(F.col("v"), F.col("r")), rows, ["v", "r"]) == [evaluated(*r) for r in rows]

    def compared(v, name):
        raw = (v or "").strip().upper()
        if any(t in name.lower() for t in ("charge", "amount", "paid", "rate")):
            try:
                return format(Decimal(re.sub("[^0-9.()-]", "", raw).replace("(", "-").replace(")", "")).normalize(), "f") if raw else ""
            except InvalidOperation:
                return raw
        if "date" in name.lower() or "dob" in name.lower():
            return re.sub("[^0-9]", "", raw)
        return re.sub("[^A-Z0-9]", "", raw) if name != "remark" else " ".join(raw.split())

    names = ["Total_Charge", "paid", "birth_date", "member_name", "icd", "remark"]
    rows = [(v, names[i % 6]) for i, v in enumerate((values + [None]) * 6)] + [("0.00", "paid"), ("-0", "paid"), ("(5.10)", "rate"), ("100", "rate"), ("1000", "paid"), ("10.00", "paid")]
    # ")" is dropped, "(" is a minus
    assert over(spark, fields.agreement_form(F.col("n"), F.col("v")), [(v, n) for v, n in rows], ["v", "n"]) == [compared(*r) for r in rows]


def test_datatypes(spark):
    cases = {
        "MONEY": (["$ 1,2 00.00", "12", "5.5"], [True, True, False]), "NPI": (["123 456 7893", "123"], [True, False]), "MEMBER_ID": (["ab-12", "-abcd", "A1"], [True, False, False]), "TAX_ID": (["12-3456789", "1-23456789"], [True, False]), "CPT_HCPCS": (["99213", "g0101", "9921"], [True, True, False]),
        "ICD": (["J45.909:", "u071", "J4"], [True, False, False]), "REVENUE_CODE": (["0450", "450"], [True, False]), "TYPE_OF_BILL": (["131", "0131", "13"], [True, True, False]), "INTEGER": (["0012", "1.0"], [True, False]), "DATE": (["7/4/2024", "7-4-24", ":2024-07-04", "07042024"], [True, False, True, False]),
        "NAME": (["Jane Doe:", "Jane", "J Doe", "a' b. c- d. e. f. g."], [True, False, False, False]), "TEXT": ([":", " x"], [False, True]), "ADDRESS": (["", "1 Main"], [False, True]), "OTHER": (["x", None], [False, False]),
    }
    rows = [(v, kind) for kind, (vs, _) in cases.items() for v in vs]
    assert over(spark, fields.valid_datatype(F.col("v"), F.col("k")), rows, ["v", "k"]) == [w for _, ws in cases.values() for w in ws]


def test_table_cells(spark):
    cases = [
        ("  ", "charge", ("", "PRESERVE_BLANK", "VALID_BLANK", False)), (None, "x", ("", "PRESERVE_BLANK", "VALID_BLANK", False)), ("123-456-7893", "rendering_NPI", ("1234567893", "NPI_DIGITS", "VALID", True)), ("123-456-7890", "npi", ("123-456-7890", "NPI_DIGITS", "INVALID", False)),
        ("j45. 9 .", "diagnosis", ("J45.9", "CODE_CASE_SPACE", "VALID", True)), ("j45.", "procedure", ("J45.", "CODE_CASE_SPACE", "VALID", True)), ("a-b", "revenue", ("A-B", "CODE_CASE_SPACE", "INVALID", False)), ("7 4 24", "service_date", ("2024-07-04", "VALID_DATE_ISO", "VALID", True)),
        ("7/4-0050", "date", ("2050-07-04", "VALID_DATE_ISO", "VALID", True)), ("13/4/2024", "date", ("13/4/2024", "VALID_DATE_ISO", "INVALID", False)), ("7/4/202", "date", ("7/4/202", "VALID_DATE_ISO", "INVALID", False)), ("| ($ 1,200.50) |", "total_charge", ("-1200.50", "CURRENCY_EVIDENCE", "VALID", True)),
        ("12.5", "paid", ("12.5", "CURRENCY_EVIDENCE", "INVALID", False)), ("1,200", "amount", ("1200", "CURRENCY_EVIDENCE", "VALID", True)), ("(5 )", "amount", ("(5 )", "CURRENCY_EVIDENCE", "INVALID", False)), (" a \n b ", "remark", ("a b", "WHITESPACE_ONLY", "NOT_APPLICABLE", False)),
    ]
    got = over(spark, fields.table_cell(F.col("v"), F.col("c")), [c[:2] for c in cases], ["v", "c"])
    assert [tuple(r) for r in got] == [c[2] for c in cases]


def test_a_cell_is_squeezed_once(spark):
    cells = spark.createDataFrame([("a", "b")], "v string, c string").select(fields.table_cell(F.col("v"), F.col("c")).alias("x")).select("x.value", "x.change", "x.status")
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(v") == 1


def test_field_readings(spark):
    cases = [
        ("patient_last", "Montgomery-Featherstonehaugh, Jo", [("MONTGOMERY-FEATHERSTONEHAUGH", ["person_name_component"]), ("MONTGOMERY-FEATHERST", ["person_name_component", "fixed_width_output_projection"])]), ("patient_first", "Doe, Jane Q.", [("JANE", ["person_name_component"])]), ("patient_first", "Doe  Maximiliana", [("MAXIMILIANA", ["person_name_component"]), ("MAXIMILIA", ["person_name_component", "fixed_width_output_projection"])]),
        ("patient_last", " Jane \t ", [("Jane", ["non_empty"])]), ("patient_last", "Jane Doe 1", [("Jane Doe 1", ["non_empty"])]), ("provider_npi", "123-456-7893", [("1234567893", ["ten_digits", "npi_checksum"])]), ("provider_npi", "1234567890", []), ("federal_tax_no", "12-3456789", [("123456789", ["nine_digit_tax_id"])]), ("insured_zip", "12345-678", []),
        ("patient_zip", "12345 6789", [("123456789", ["zip_length"])]), ("patient_dob", "02/29/2024", [("02292024", ["valid_calendar_date"])]), ("patient_dob", "02/30/24", [("023024", ["valid_calendar_date"])]), ("patient_dob", "00/00/00", []), ("type_of_bill", "0131", [("131", ["three_digit_bill_type"])]), ("type_of_bill", "1131", []), ("principal_diagnosis", " j45.909", [("J45.909", ["diagnosis_format"])]),
        ("principal_diagnosis", "j4", []), ("patient_control_number", "a-1 b", [("A1B", ["identifier_format"])]), ("patient_control_number", "--", []), ("total_charges", "$1,200.005", [("1200.00", ["valid_decimal"])]), ("total_charge", "-", []), ("remark", " a  b ", [("a b", ["non_empty"])]), ("remark", "  ", []), ("remark", None, []),
    ]
    got = over(spark, readings.field_readings(F.col("f"), F.col("v")), [c[:2] for c in cases], ["f", "v"])
    assert [[tuple(r) for r in rs] for rs in got] == [c[2] for c in cases]


def plain_cells(raw, kind):
    v = (raw or "").strip().upper()
    digits, compact, out = re.sub(r"\D", "", v), re.sub("[^A-Z0-9]", "", v), {}
    if kind == "date":
        for width, form, shown in ((6, "%m%d%y", "%m %d %y"), (8, "%m%d%Y", "%m %d %Y")):
            for c in [digits] * (len(digits) == width) + [digits[:i] + digits[i + 1 :] for i in range(len(digits))] * (len(digits) == width + 1):
                try:
                    day = datetime.datetime.strptime(c, form)
                except ValueError:
                    continue
                out.setdefault(f"{c[:2]} {c[2:4]} {c[4:]}", "CALENDAR_VALIDATED_SINGLE_NOISE_DELETION")
                assert day.year < 1000 or day.strftime(shown) == f"{c[:2]} {c[2:4]} {c[4:]}"
    if kind in ("code", "text", "integer", "numeric"):
        for i, c in enumerate(compact):
            for to in readings.CELL_CONFUSIONS.get(c, ""):
                out.setdefault(compact[:i] + to + compact[i + 1 :], f"SINGLE_CHARACTER_CONFUSION_{c}_TO_{to}")
        if kind == "code" and len(compact) <= 5:
            for i in range(1, len(compact) - 1):
                out.setdefault(compact[:i] + compact[i + 1 :], "SHORT_CODE_SINGLE_NOISE_DELETION")
    return [(a, b) for a, b in out.items() if a and a != v]


def test_cell_readings(spark):
    values = ["0103021999", "1302199", "1022024", "010220245", "9", "99213", "J4S", "O0IL8BRVY4", "", None, *made_up(4, 300, list("0123456789") + ["01", "19", "2024"], 5), *made_up(5, 200, list("01OIL48BRVYX -."), 7)]
    rows = [(v, k) for v in values for k in ("date", "code", "text", "date_of")]
    got = over(spark, readings.cell_readings(F.col("v"), F.col("k")), rows, ["v", "k"])
    assert [[tuple(r) for r in rs] for rs in got] == [plain_cells(*r) for r in rows]


def plain_box(address, postcode):
    m = re.fullmatch(r"\s*PO\s+BOX\s+(\d+)([0-9OBISL/]*)\s*", (address or "").upper())
    code = re.sub(r"\D", "", postcode or "")
    if not m or len(code) != 9 or not re.search("[OBISL/]", m[2]):
        return address
    shared = [k for k in range(1, 5) if m[1].endswith(code[5 : 5 + k])]
    return f"PO BOX {m[1]}{code[5 + max(shared, default=0) :]}"


def test_box_by_postcode(spark):
    rows = [("PO BOX 94O/7", "12345-4077"), ("po \t box 9407B7", "123454077"), ("PO BOX 9407", "123454077"), ("PO BOX O407", "123454077"), ("PO BOX 940B", "12345"), ("12 Main St", "123454077"), (" PO BOX 1234S ", "123451234"), ("PO BOX 9B", None), (None, "123454077")]
    rows += [("PO BOX " + a, "12345" + b) for a, b in zip(made_up(6, 300, list("123412OBS"), 6), made_up(7, 300, list("1234"), 5), strict=True)]
    assert over(spark, readings.box_by_postcode(F.col("a"), F.col("p")), rows, ["a", "p"]) == [plain_box(*r) for r in rows]
    assert plain_box(*rows[0]) == "PO BOX 94077"
    assert over(spark, readings.number_without_letters(F.col("a")), [("oIlbS/7",)], ["a"]) == ["0118577"]


def test_checked_fields_and_consensus(spark):
    cases = [
        ("DATE_FROM", "07/16/2025", ("2025-07-16", True, "VALID_DATE")), ("charges", "($5)", ("-5.00", True, "VALID_AMOUNT")), ("provider_npi", "123-456-7893", ("1234567893", True, "VALID_NPI_CHECKSUM")), ("provider_npi", "123", (None, False, "VALID_NPI_CHECKSUM")), ("service_units", "02.0", ("02.0", True, "VALID_POSITIVE_UNITS")), ("service_units", "0", (None, False, "VALID_POSITIVE_UNITS")), ("service_units", "1.5", (None, False, "VALID_POSITIVE_UNITS")),
        ("revenue_code", "04 50", ("0450", True, "VALID_REVENUE_CODE_FORMAT")), ("cpt_code", "g01 01", ("G0101", True, "VALID_PROCEDURE_CODE_FORMAT")), ("diagnosis_code", "j45.9..", ("J45.9", True, "VALID_DIAGNOSIS_FORMAT")), ("diagnosis_code", "u45", (None, False, "VALID_DIAGNOSIS_FORMAT")), ("place_of_service", "11", ("11", True, "VALID_PLACE_OF_SERVICE_FORMAT")), ("type_of_bill", "0131", (None, False, "VALID_TYPE_OF_BILL_FORMAT")),
        ("patient_sex", " f", ("F", True, "VALID_SEX_CODE")), ("rel_code", "g8", ("G8", True, "VALID_RELATIONSHIP_CODE")), ("emergency_indicator", "x", (None, False, "VALID_EMERGENCY_INDICATOR")), ("diagnosis_pointer", "a  12 l", ("A 12 L", True, "VALID_DIAGNOSIS_POINTERS")), ("diagnosis_pointer", "a b c d e", (None, False, "VALID_DIAGNOSIS_POINTERS")), ("modifiers", "25 rt", ("25 RT", True, "VALID_MODIFIER_FORMAT")), ("remark", "x", (None, False, "NO_DETERMINISTIC_RULE")), ("patient_sex", None, (None, False, "VALID_SEX_CODE")),
    ]
    got = over(spark, readings.checked_field(F.col("f"), F.col("v")), [c[:2] for c in cases], ["f", "v"])
    assert [tuple(r) for r in got] == [c[2] for c in cases]
    marks = [("F", "CROSS_FAMILY_AGREEMENT", ("F", True, "VALID_SEX_CODE")), ("F", "", ("F", False, "INDEPENDENT_CONSENSUS_REQUIRED")), ("Z", "CROSS_FAMILY_AGREEMENT", (None, False, "VALID_SEX_CODE")), (" ", "REFERENCE_VERIFIED_BLANK", ("", True, "INDEPENDENT_BLANK_CONSENSUS")), (None, "CROSS_FAMILY_AGREEMENT", (None, False, "INDEPENDENT_BLANK_CONSENSUS_REQUIRED")), ("F", None, ("F", False, "INDEPENDENT_CONSENSUS_REQUIRED"))]
    got = over(spark, readings.accepted_by_consensus(F.lit("patient_sex"), F.col("v"), F.split("m", ",")), [m[:2] for m in marks], ["v", "m"])
    assert [tuple(r) for r in got] == [m[2] for m in marks]


def test_local_candidates(spark):
    taken, failed, empty = ["RAPID_CANDIDATE_DETERMINISTICALLY_VALID"], ["PRIMARY_VALIDATION_FAILED", "SECONDARY_OCR_SELECTIVE"], ["EMPTY_PRIMARY_CANDIDATE", "SECONDARY_OCR_SELECTIVE"]
    cases = [
        (" ", "DATE", (False, None, "TESSERACT_CONSTRAINED", empty)), ("x", "DATE", (False, None, "TESSERACT_CONSTRAINED", failed)), ("07/16/2025", "DATE", (True, "2025-07-16", None, taken)), ("1234567893", "NPI", (True, "1234567893", None, taken)), ("1234567890", "NPI", (False, "1234567890", None, failed)), ("g 0101", "CPT_HCPCS", (True, "G0101", None, taken)), ("j45.9", "ICD_CODE", (True, "J45.9", None, taken)), ("j4c", "ICD_CODE", (False, "J4C", "TESSERACT", failed)),
        ("13", "TYPE_OF_BILL", (False, "13", None, failed)), ("12-3456789", "TAX_IDENTIFIER", (True, "123456789", None, taken)), ("jane  doe", "PERSON_NAME", (True, "jane doe", None, taken)), ("j doe", "PERSON_NAME", (False, "j doe", "PADDLE", failed)), ("jane doe md", "PERSON_OR_ORGANIZATION", (True, "jane doe md", None, taken)), ("doe md", "PERSON_OR_ORGANIZATION", (False, "doe md", "PADDLE", failed)), ("jane doemd", "PERSON_OR_ORGANIZATION", (False, "jane doemd", "PADDLE", failed)),
        ("saint cityhospital", "PERSON_OR_ORGANIZATION", (False, "saint cityhospital", "PADDLE", failed)), ("saint hospital", "PERSON_OR_ORGANIZATION", (True, "saint hospital", None, taken)), ("$5", "CURRENCY", (True, "5.00", None, taken)), ("x", "CHECKBOX", (True, "True", None, taken)), ("?", "CHECKBOX", (False, None, None, failed)), (" a ", "REMARK", (True, "a", None, taken)), (None, "REMARK", (False, None, None, empty)),
    ]
    got = over(spark, readings.local_candidate(F.col("v"), F.col("k")), [c[:2] for c in cases], ["v", "k"])
    assert [tuple(r) for r in got] == [c[2] for c in cases]


def test_strict_totals(spark):
    claims = spark.createDataFrame([(1, "30.00"), (2, "$30"), (3, "31"), (4, "30"), (5, " "), (6, "30"), (7, None), (8, "3O")], "c int, total string")
    lines = spark.createDataFrame([(1, "10.00"), (1, "20.0"), (2, "30"), (3, "30"), (5, "1"), (6, "10"), (6, "2O"), (6, None), (9, "1")], "c int, charge string")
    got = {r.c: (r.state, None if r.difference is None else str(r.difference), r.changed) for r in totals.reconciled(claims, lines, "c", F.col("total"), F.col("charge")).collect()}
    assert got == {
        1: ("EXACT_MATCH", "0.00", False), 2: ("DETERMINISTIC_NORMALIZATION_MATCH", "0.00", True), 3: ("ARITHMETIC_CONFLICT", "1.00", False), 4: ("MISSING_SERVICE_LINES", None, False), 5: ("MISSING_TOTAL", None, False), 6: ("AMBIGUOUS", None, False), 7: ("MISSING_TOTAL", None, False), 8: ("MISSING_TOTAL", None, False),
    }


def test_cell_faults(spark):
    good = (0, 0, 5, 5, 1, 0, 0.5, "a" * 64, "PROMOTED", True)
    changes = [({}, []), ({2: 0}, ["BOX_WITHOUT_AREA"]), ({1: None}, ["BOX_WITHOUT_AREA"]), ({4: 0}, ["PAGE_NOT_VALID"]), ({5: -1}, ["INDEX_NOT_VALID"]), ({6: 1.01}, ["CONFIDENCE_NOT_VALID"]), ({7: "A" * 64, 8: None}, ["DIGEST_NOT_VALID", "REVIEW_ONLY_IS_NEVER_AUTOMATIC"]), ({8: "REVIEW_ONLY"}, ["REVIEW_ONLY_IS_NEVER_AUTOMATIC"]), ({8: "REVIEW_ONLY", 9: None}, []), ({6: None, 7: None}, ["CONFIDENCE_NOT_VALID", "DIGEST_NOT_VALID"])]
    rows = [tuple(ch.get(k, v) for k, v in enumerate(good)) for ch, _ in changes]
    c = [F.col(x) for x in "abcdefghij"]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f int, g double, h string, i string, j boolean").coalesce(1)
    assert [r.x for r in df.select(fields.cell_faults(c[:4], c[4], [c[5]], c[6], c[7], c[8], c[9]).alias("x")).collect()] == [want for _, want in changes]
