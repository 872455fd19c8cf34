"""How a raw reading may be meant: readings of fields and cells, checks by a field's name, and the gate of a local candidate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, text

_TRIED = "array<struct<value:string,tags:array<string>>>"

#: Most characters of a name part in a record.
NAME_WIDTHS = {"patient_last": 20, "patient_first": 9}
#: Characters that OCR confuses, and what else each may be.
CELL_CONFUSIONS = {"0": "O", "O": "0", "1": "IL", "I": "1", "L": "1", "4": "1", "8": "B", "B": "8R", "R": "B", "V": "Y", "Y": "V"}
#: Letters read for digits in a number.
NUMBER_LETTERS = ("OILBS/", "011857")

#: Fields checked by shape alone: what a value is cut down to, its shape then, and the name of the check.
FIELD_CHECKS = (
    (("revenue_code",), "joined", "^[0-9]{4}$", "VALID_REVENUE_CODE_FORMAT"),
    (("procedure_code", "cpt_code", "hcpcs_rate_hipps_code"), "joined", "^[A-Z0-9]{4,5}$", "VALID_PROCEDURE_CODE_FORMAT"),
    (("principal_diagnosis", "diagnosis_code"), "dotless", r"^[A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?$", "VALID_DIAGNOSIS_FORMAT"),
    (("place_of_service",), "given", "^[0-9]{2}$", "VALID_PLACE_OF_SERVICE_FORMAT"),
    (("type_of_bill",), "given", "^[1-8][1-8][0-9]$", "VALID_TYPE_OF_BILL_FORMAT"),
    (("patient_sex",), "upper", "^[MFU]$", "VALID_SEX_CODE"),
    (("rel_code",), "upper", "^(?:SELF|SPOUSE|CHILD|OTHER|01|02|09|19|G8)$", "VALID_RELATIONSHIP_CODE"),
    (("emergency_indicator",), "upper", "^[YN]$", "VALID_EMERGENCY_INDICATOR"),
    (("diagnosis_pointer",), "words", "^(?:[A-L]|[1-9]|1[0-2])(?: (?:[A-L]|[1-9]|1[0-2])){0,3}$", "VALID_DIAGNOSIS_POINTERS"),
    (("modifier", "modifiers"), "words", "^[A-Z0-9]{2}(?: [A-Z0-9]{2}){0,3}$", "VALID_MODIFIER_FORMAT"),
    (("service_units",), "given", r"^[+]?(?=0*[1-9])[0-9]+(?:\.0*)?$", "VALID_POSITIVE_UNITS"),
)
#: Fields whose values are dates, amounts, or numbers of providers.
DATE_FIELDS = ("date_from", "date_to", "service_date")
AMOUNT_FIELDS = ("charges", "charge", "adjustment", "insurance_paid", "patient_paid")
PROVIDER_FIELDS = ("rendering_provider_npi", "provider_npi")
#: Markers that an empty field has been found empty by someone else as well.
BLANK_MARKERS = ("CROSS_ENGINE_BLANK_AGREEMENT", "REFERENCE_VERIFIED_BLANK")

#: How a datatype's values are brought in form; all others are text.
FORM_OF = {"DATE": "date", "CURRENCY": "currency", "NPI": "npi", "CHECKBOX": "checkbox", "ALPHANUMERIC_ID": "code", "CPT_HCPCS": "code", "ICD_CODE": "code", "TYPE_OF_BILL": "code", "TAX_IDENTIFIER": "tax_id"}
#: Shapes that values of a datatype have then; names in capitals.
LOCAL_SHAPES = {
    "CPT_HCPCS": "^(?:[0-9]{5}|[A-Z][0-9]{4})$", "ICD_CODE": r"^[A-TV-Z][0-9][0-9AB](?:\.[A-Z0-9]{1,4})?$", "TYPE_OF_BILL": "^[0-9]{3,4}$", "TAX_IDENTIFIER": "^[0-9]{9}$", "PERSON_NAME": "^[A-Z]{2,}(?: [A-Z]{2,})+$", "PERSON_OR_ORGANIZATION": "^[A-Z]{2,}(?: [A-Z]{2,})+$",
}
#: Words that end the name of an organization.
ORGANIZATION_ENDS = ("HOSPITAL", "CENTER", "SYSTEM", "CLINIC", "HEALTH")
#: The second reader of a datatype; others have none.
SECOND_READERS = {
    "NUMERIC": "TESSERACT", "DATE": "TESSERACT_CONSTRAINED", "ALPHANUMERIC_ID": "TESSERACT", "TAX_IDENTIFIER": "TESSERACT", "CPT_HCPCS": "TESSERACT", "ICD_CODE": "TESSERACT", "PERSON_NAME": "PADDLE", "PERSON_OR_ORGANIZATION": "PADDLE", "ADDRESS": "PADDLE", "TABLE": "REGIONAL_OCR",
}


def _pick(key: Column, choices: dict[str, Column], otherwise: Column) -> Column:
    return reduce(lambda out, kv: F.when(key == kv[0], kv[1]).otherwise(out), choices.items(), otherwise)


def _reading(value: Column, *tags: str) -> Column:
    return F.array(F.struct(value.alias("value"), F.array(*map(F.lit, tags)).alias("tags"))).cast(_TRIED)


def field_readings(field: Column, raw: Column) -> Column:
    """The values that a field's raw text may stand for, as structs (value, tags): none for an empty text, or one that doesn't have the field's form.

    Of a name in parts the field's own part, and a second time cut to the
    record's width if it is longer. Fields without a rule: the text itself.
    """
    v = text.stripped(F.coalesce(raw, F.lit("")))
    none = F.array().cast(_TRIED)
    digits, code = text.only_digits(v), F.regexp_replace(F.upper(v), "[^A-Z0-9.]", "")
    when = lambda fits, value, *tags: F.when(F.coalesce(fits, F.lit(False)), _reading(value, *tags)).otherwise(none)
    bill = F.when(digits.rlike("^0[0-9]{3}$"), F.substring(digits, 2, 3)).otherwise(digits)
    identifier = F.regexp_replace(code, "[.]", "")
    total = text.amount_text(F.regexp_replace(v, r"[^0-9.\-]", ""))
    plain = _reading(text.squeezed(v), "non_empty")
    tax, zip_, charge = when(F.length(digits) == 9, digits, "nine_digit_tax_id"), when(F.length(digits).isin(5, 9), digits, "zip_length"), when(total.isNotNull(), total, "valid_decimal")

    parts = F.filter(F.transform(F.split(v, rf"[,.;|]+|(?:{text.WHITE[:-1]}){{2,}}"), lambda p: text.stripped(F.regexp_replace(p, "[^A-Za-z' -]", ""))), lambda p: p != "")

    def name_part(of: str, part: Column) -> Column:
        name = F.upper(part)
        short = _reading(F.substring(name, 1, NAME_WIDTHS[of]), "person_name_component", "fixed_width_output_projection")
        both = F.when(F.length(name) > NAME_WIDTHS[of], F.concat(_reading(name, "person_name_component"), short)).otherwise(_reading(name, "person_name_component"))
        return F.when(F.size(parts) >= 2, both).otherwise(plain)

    rules = {
        "patient_last": name_part("patient_last", F.get(parts, F.lit(0))), "patient_first": name_part("patient_first", F.get(F.split(F.get(parts, F.lit(1)), " +"), F.lit(0))),
        "provider_npi": when(text.valid_npi(digits), digits, "ten_digits", "npi_checksum"), "federal_tax_id": tax, "federal_tax_no": tax, "patient_zip": zip_, "insured_zip": zip_,
        "patient_dob": when(dates.first_date(digits, dates.DIGIT_FORMATS).isNotNull(), digits, "valid_calendar_date"), "type_of_bill": when(F.length(bill) == 3, bill, "three_digit_bill_type"),
        "principal_diagnosis": when(code.rlike("^[A-Z0-9][A-Z0-9.]{2,7}$"), code, "diagnosis_format"), "patient_control_number": when(identifier != "", identifier, "identifier_format"), "total_charge": charge, "total_charges": charge,
    }
    return F.when(v == "", none).otherwise(_pick(field, rules, plain))


def cell_readings(raw: Column, kind: Column) -> Column:
    """Other readings of a cell, as structs (value, method), each once and none equal to the cell: for review only, never to be accepted unseen.

    A date of six or eight digits, or one too many, that is a calendar date; a
    code, text or number with one confused character exchanged; a code of up to
    five characters without one inside. As many readings as there are confused
    characters, each as long as the cell.
    """
    v = F.upper(text.stripped(F.coalesce(raw, F.lit(""))))
    digits, compact = text.only_digits(v), F.regexp_replace(v, "[^A-Z0-9]", "")
    tried = "array<struct<value:string,method:string>>"
    none = F.array().cast(tried)
    read = lambda value, method: F.struct(value.alias("value"), method.alias("method"))
    without = lambda s, i: F.concat(F.substring(s, F.lit(1), i), F.substring(s, i + 2, F.length(s)))
    places = lambda s, lo, n: F.when(n > lo, F.sequence(F.lit(lo), n - 1)).otherwise(F.array().cast("array<int>"))

    def calendar(width: int, form: str) -> Column:
        n = F.length(digits)
        each = F.when(n == width, F.array(digits)).when(n == width + 1, F.transform(places(digits, 0, F.lit(width + 1)), lambda i: without(digits, i))).otherwise(F.array().cast("array<string>"))
        real = F.filter(each, lambda d: dates.date_in(d, form).isNotNull())
        shown = lambda d: F.concat_ws(" ", F.substring(d, 1, 2), F.substring(d, 3, 2), F.substring(d, 5, 4))
        return F.transform(real, lambda d: read(shown(d), F.lit("CALENDAR_VALIDATED_SINGLE_NOISE_DELETION")))

    others = F.create_map(*(x for c, to in CELL_CONFUSIONS.items() for x in (F.lit(c), F.array(*map(F.lit, to)))))
    at = lambda i: F.substring(compact, i + 1, F.lit(1))
    exchanged = F.flatten(F.transform(places(compact, 0, F.length(compact)), lambda i: F.transform(
        F.coalesce(F.try_element_at(others, at(i)), F.array().cast("array<string>")),
        lambda to: read(F.concat(F.substring(compact, F.lit(1), i), to, F.substring(compact, i + 2, F.length(compact))), F.concat(F.lit("SINGLE_CHARACTER_CONFUSION_"), at(i), F.lit("_TO_"), to)),
    )))
    shorter = F.when((kind == "code") & (F.length(compact) <= 5), F.transform(places(compact, 1, F.length(compact) - 1), lambda i: read(without(compact, i), F.lit("SHORT_CODE_SINGLE_NOISE_DELETION")))).otherwise(none)
    found = F.when(kind == "date", F.concat(calendar(6, "mdy"), calendar(8, "mdY"))).when(kind.isin("code", "text", "integer", "numeric"), F.concat(exchanged, shorter)).otherwise(none)
    return F.array_distinct(F.filter(found, lambda r: (r["value"] != "") & (r["value"] != v))).cast(tried)


def box_by_postcode(address: Column, postcode: Column) -> Column:
    """An address that is a post office box whose number has letters in it, completed by the last four digits of a nine-digit postcode.

    The number's clear digits stay, and what of the four they end in isn't
    repeated. Any other address stays as it is.
    """
    low = F.regexp_extract(F.upper(address), rf"^{text.WHITE[:-1]}*PO{text.WHITE}BOX{text.WHITE}([0-9OBISL/]+){text.WHITE[:-1]}*$", 1)
    clear = F.regexp_extract(low, "^[0-9]+", 0)
    code = text.only_digits(F.coalesce(postcode, F.lit("")))
    last = F.right(code, F.lit(4))
    shared = F.greatest(*(F.when(F.right(clear, F.lit(k)) == F.left(last, F.lit(k)), F.when(F.length(clear) >= k, k)).otherwise(0) for k in range(1, 5)))
    fits = (clear != "") & low.rlike("[OBISL/]") & (F.length(code) == 9)
    return F.when(fits, F.concat(F.lit("PO BOX "), clear, F.substring(last, F.coalesce(shared, F.lit(0)) + 1, F.lit(4)))).otherwise(address)


def number_without_letters(value: Column) -> Column:
    """Letters and strokes that OCR reads for digits, put right; only for fields that are numbers."""
    return F.translate(F.upper(value), *NUMBER_LETTERS)


def checked_field(field: Column, raw: Column) -> Column:
    """Struct (value, valid, evidence): a value in form, if it passes the check that its field's name stands for."""
    v, name = text.stripped(F.coalesce(raw, F.lit(""))), F.lower(field)
    cut = {"given": v, "upper": F.upper(v), "joined": F.upper(F.regexp_replace(v, text.WHITE, "")), "words": F.upper(text.squeezed(v))}
    cut["dotless"] = F.rtrim(cut["joined"], F.lit("."))
    digits = text.only_digits(v)
    value, evidence = F.lit(None).cast("string"), F.lit("NO_DETERMINISTIC_RULE")
    rules = [
        (DATE_FIELDS, dates.parse_date(v).cast("string"), "VALID_DATE"), (AMOUNT_FIELDS, text.money_text(v), "VALID_AMOUNT"), (PROVIDER_FIELDS, F.when(text.valid_npi(digits), digits), "VALID_NPI_CHECKSUM"),
        *((names, F.when(cut[how].rlike(shape), cut[how]), says) for names, how, shape, says in FIELD_CHECKS),
    ]
    for names, found, says in rules:
        value, evidence = F.when(name.isin(*names), found).otherwise(value), F.when(name.isin(*names), says).otherwise(evidence)
    return F.struct(value.alias("value"), value.isNotNull().alias("valid"), evidence.alias("evidence"))


def accepted_by_consensus(field: Column, value: Column, validations: Column) -> Column:
    """Struct (value, valid, evidence): whether a value may be taken without review: it passes its field's check, and readers of different families agree.

    An empty one only if someone else found the field empty as well.
    """
    marks = F.coalesce(validations, F.array().cast("array<string>"))
    empty = text.stripped(F.coalesce(value, F.lit(""))) == ""
    blank, agreed = F.arrays_overlap(marks, F.array(*map(F.lit, BLANK_MARKERS))), F.array_contains(marks, "CROSS_FAMILY_AGREEMENT")
    blank, agreed = F.coalesce(blank, F.lit(False)), F.coalesce(agreed, F.lit(False))
    c = checked_field(field, value)
    return F.struct(
        F.when(empty, F.when(blank, "")).otherwise(c["value"]).alias("value"), F.when(empty, blank).otherwise(agreed & c["valid"]).alias("valid"),
        F.when(empty & blank, "INDEPENDENT_BLANK_CONSENSUS").when(empty, "INDEPENDENT_BLANK_CONSENSUS_REQUIRED").when(~agreed, "INDEPENDENT_CONSENSUS_REQUIRED").otherwise(c["evidence"]).alias("evidence"),
    )


def in_form(kind: Column, raw: Column) -> Column:
    """Struct (value, ok): a raw text brought in its type's form (date, currency, npi, tax_id, code, checkbox, else text)."""
    v = F.coalesce(raw, F.lit(""))
    box = text.normalize_checkbox(v)
    code = F.upper(F.regexp_replace(v, text.WHITE, ""))
    plain = text.squeezed(v)
    forms = {"date": dates.parse_date(v).cast("string"), "currency": text.money_text(v), "npi": text.digits_of_length(v, 10), "tax_id": text.digits_of_length(v, 9), "code": code, "checkbox": F.when(box, "True").when(~box, "False")}
    value = _pick(kind, forms, plain)
    return F.struct(value.alias("value"), F.coalesce(value != "", F.lit(False)).alias("ok"))


def local_candidate(raw: Column, datatype: Column, second: dict[str, str] | None = None) -> Column:
    """Struct (accepted, value, second, reasons): whether a local reading of a datatype is taken; if not, the reader that has to look again (null: none)."""
    second = SECOND_READERS if second is None else second
    formed = in_form(_pick(datatype, {k: F.lit(v) for k, v in FORM_OF.items()}, F.lit("text")), raw)
    value = formed["value"]
    name = F.upper(value)
    words = F.split(name, " ")
    ends = F.exists(words, lambda w: reduce(lambda a, e: a | (F.endswith(w, F.lit(e)) & (w != e)), ORGANIZATION_ENDS, F.lit(False)))
    titled = (F.element_at(words, -1) == "MD") & (F.size(words) < 3) | F.exists(words, lambda w: (F.length(w) > 2) & F.endswith(w, F.lit("MD")))
    shaped = {k: (name if k.startswith("PERSON") else value).rlike(shape) for k, shape in LOCAL_SHAPES.items()}
    valid = _pick(datatype, {**shaped, "NPI": text.valid_npi(value), "PERSON_OR_ORGANIZATION": shaped["PERSON_OR_ORGANIZATION"] & ~titled & ~ends}, value != "")
    empty = text.stripped(F.coalesce(raw, F.lit(""))) == ""
    accepted = ~empty & formed["ok"] & F.coalesce(valid, F.lit(False))
    reader = _pick(datatype, {k: F.lit(v) for k, v in second.items()}, F.lit(None).cast("string"))
    why = F.when(accepted, F.array(F.lit("RAPID_CANDIDATE_DETERMINISTICALLY_VALID"))).otherwise(F.array(F.when(empty, "EMPTY_PRIMARY_CANDIDATE").otherwise("PRIMARY_VALIDATION_FAILED"), F.lit("SECONDARY_OCR_SELECTIVE")))
    return F.struct(accepted.alias("accepted"), F.when(~empty, value).alias("value"), F.when(~accepted, reader).alias("second"), why.alias("reasons"))
