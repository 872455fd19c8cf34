"""What a candidate value may be for its field: graded compatibility, validity, repairs, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compression methods by the tag of a TIFF directory.
TIFF_COMPRESSIONS = {1: "UNCOMPRESSED", 2: "CCITT_G3", 3: "CCITT_G3", 4: "CCITT_G4", 5: "LZW", 6: "JPEG", 7: "JPEG", 8: "DEFLATE", 32773: "PACKBITS"}

#: Shapes of a datatype's values, what a value of the shape is worth, and any other value.
GRADES = {
    "ICD_CODE": (r"(?i)^[A-TV-Z][0-9A-Z]{2}(?:\.?[0-9A-Z]{1,4})?(?: [A-TV-Z][0-9A-Z]{2}(?:\.?[0-9A-Z]{1,4})?)*$", 1.0, 0.1), "CPT_HCPCS": (r"(?i)^(?:[0-9]{5}|[A-Z][0-9]{4})$", 1.0, 0.1), "CURRENCY": (r"^\$?[0-9][0-9,]*(?:\.[0-9]{1,2})?$", 1.0, 0.1),
    "ALPHANUMERIC_ID": (r"^[A-Za-z0-9-]{5,24}$", 0.95, 0.15),
}
#: Datatypes judged by their digits alone.
DIGIT_GRADES = {"NPI": (r"^[0-9]{10}$", 1.0, 0.0), "TYPE_OF_BILL": (r"^0?[0-9]{3}$", 1.0, 0.1), "TAX_IDENTIFIER": (r"^[0-9]{9}$", 1.0, 0.2)}
#: Datatypes of free text, and form labels that don't belong in one.
TEXT_TYPES = ("PERSON_NAME", "PERSON_OR_ORGANIZATION", "ADDRESS", "TEXT")
FORM_LABELS = ("SYNTHETIC", "DOCUMENT", "OFFICIAL FORM", "PATIENT NAME", "PROVIDER NAME", "RELATIONSHIP", "TOTAL CHARGE")
#: Words that label an address or a city, and words that streets end in.
PLACE_LABELS = ("PATIENT", "ADDRESS", "CITY", "STATE", "ZIP", "INSURED")
STREETS = ("STREET", "ST", "ROAD", "RD", "AVENUE", "AVE", "LANE", "LN", "DRIVE", "DR")
#: Fixed value: a stroke and a number that a form's line leaves behind an address.
STREET_NOISE = r"\s+[.|]\s*[0-9]+\s*[.]?\s*$"
#: Labels of a form that a name or an address read from it may hold by mistake.
READ_LABELS = r"(?i)\b(?:PATIENT'?S?|ADDRESS|BIRTH\s*DATE|ADMISSION|SEX|STREET|CITY|STATEA?|STAEA|ZIP\s*CODE|INSURED|CLAIM)\b"
#: For fields whose name matches, the shapes a value must have, all of them, and those it mustn't have, any of them.
CANDIDATE_RULES = (
    ("^rel_code$", ("(?i)^(?:01|02|19|G8|09)$",), ()),
    ("^patient_sex$", ("(?i)^[MFU]$",), ()),
    ("_state$", ("^[A-Za-z]{2}$",), ()),
    ("^federal_tax_(?:id|no)$", ("^[0-9]{9}$",), ()),
    ("_zip$", ("^(?:[0-9]{5}|[0-9]{9})$",), ("^999999999$",)),
    ("^insured_(?:addr1|addr2|city)$", (), ("(?i)^NA$",)),
    ("^patient_(?:first|last)$", ("^[ ,]*[A-Za-z][A-Za-z'.-]*[ ,]*$",), (READ_LABELS, r"\S\s+\S+\s+\S")),
    ("(?:addr1|addr2)$", ("[0-9]", "[A-Za-z]"), (READ_LABELS,)),
    ("_city$", ("^[A-Za-z .'-]{2,}$",), ("(?i)^(?:CITY|STATE|ZIP CODE)$",)),
)
#: Formats of a date in claim evidence.
EVIDENCE_DATES = (("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "y-M-d"), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/y"), ("^[0-9]{8}$", "MMddyyyy"), ("^[0-9]{6}$", "MMddyy"), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "M/d/yy"))
_SPACE = r"\s+"


def tiff_compression(tag: Column) -> Column:
    """The compression method of a TIFF tag; OTHER for an unknown or missing one."""
    known = F.create_map(*(x for k, v in TIFF_COMPRESSIONS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(known, tag.cast("int")), F.lit("OTHER"))


def digit_date(value: Column, six_digits: bool = True) -> Column:
    """A date as ISO, as 8 digits year first, else month first, or (unless not asked for) as 6 digits month first in this century; null if none is a date."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    iso = F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))
    eight, six = F.length(digits) == 8, F.length(digits) == 6
    forms = (iso, F.when(eight, F.try_to_timestamp(digits, F.lit("yyyyMMdd"))), F.when(eight, F.try_to_timestamp(digits, F.lit("MMddyyyy"))), F.when(six, F.try_to_timestamp(F.concat(F.substring(digits, 1, 4), F.lit("20"), F.substring(digits, 5, 2)), F.lit("MMddyyyy"))))
    return F.coalesce(*forms[: 4 if six_digits else 3]).cast("date")


def type_compatibility(value: Column, kind: Column, field: Column) -> Column:
    """How well a value's form suits its datatype, 0 to 1; two fields have rules of their own. Says nothing of its truth."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    compact, digits, upper = F.regexp_replace(raw, _SPACE, " "), F.regexp_replace(raw, "[^0-9]", ""), F.upper(raw)
    identifier = raw.rlike(GRADES["ALPHANUMERIC_ID"][0])
    labelled = F.lit(False)
    for label in FORM_LABELS:
        labelled = labelled | F.contains(upper, F.lit(label))
    out = (
        F.when(raw == "", 0.0)
        .when(field == "relationship", F.when(upper.isin("SELF", "SPOUSE", "CHILD", "OTHER"), 1.0).otherwise(0.0))
        .when(field == "member_id", F.when(identifier & raw.rlike("[A-Za-z]") & raw.rlike("[0-9]"), 1.0).when(identifier, 0.45).otherwise(0.1))
        .when(kind == "DATE", F.when(digit_date(raw, six_digits=False).isNotNull(), 1.0).otherwise(0.0))
    )
    for name, (shape, good, bad) in {**GRADES, **DIGIT_GRADES}.items():
        of = digits if name in DIGIT_GRADES else compact if name in ("ICD_CODE", "CPT_HCPCS") else raw
        out = out.when(kind == name, F.when(of.rlike(shape), good).otherwise(bad))
    return out.when(kind.isin(*TEXT_TYPES), F.when(labelled, 0.05).when(~raw.rlike("[A-Za-z]"), 0.0).otherwise(0.8)).otherwise(0.7)


def evidence_date(value: Column) -> Column:
    """A date in one of the formats of claim evidence, the first that fits; two-digit years from 69 on are of the last century."""
    v = F.trim(value)
    out = []
    for shape, form in EVIDENCE_DATES:
        day = F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(form))).cast("date")
        if form.endswith("yy") and not form.endswith("yyyy"):
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        out.append(day)
    return F.coalesce(*out)


def candidate_valid(field: Column, value: Column, rules: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = CANDIDATE_RULES) -> Column:
    """Whether a value may stand in its field: it isn't empty, and meets every rule whose pattern the field's name matches."""
    out = F.coalesce(value, F.lit("")) != ""
    for fields, wanted, refused in rules:
        meets = F.lit(True)
        for shape in wanted:
            meets = meets & value.rlike(shape)
        for shape in refused:
            meets = meets & ~value.rlike(shape)
        out = out & (~F.coalesce(field.rlike(fields), F.lit(False)) | meets)
    return F.coalesce(out, F.lit(False))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Z0-9_]+"), F.lit(0))


def _has_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(_words(text), F.array(*map(F.lit, words)))


def clean_city(value: Column) -> Column:
    """A city in capitals: its runs of letters, points, apostrophes and hyphens, one blank between; null if that is less than two characters or has a label."""
    runs = F.regexp_extract_all(F.upper(F.regexp_replace(value, "[^A-Za-z.'-]", " ")), F.lit("[A-Z.'-]+"), F.lit(0))
    city = F.trim(F.array_join(runs, " "), F.lit(" .'-"))
    return F.when((F.length(city) > 1) & ~_has_word(city, PLACE_LABELS), city)


def repaired_address(value: Column) -> Column:
    """House number and street, where a parenthesis right after two digits or more is read as 2; null without a street's ending, or with a label."""
    parts = F.split(F.upper(F.trim(value)), _SPACE, 2)
    number = F.regexp_replace(parts[0], "[()]$", "2")
    runs = F.regexp_extract_all(F.regexp_replace(parts[1], STREET_NOISE, ""), F.lit("[A-Z0-9#.'-]+"), F.lit(0))
    street = F.trim(F.array_join(runs, " "), F.lit(" ."))
    fits = (F.size(parts) == 2) & parts[0].rlike("^[0-9]{2,7}[()]?$") & _has_word(street, STREETS) & ~_has_word(street, PLACE_LABELS)
    return F.when(fits, F.concat_ws(" ", number, street))


def same_as(source: Column, counterpart: Column, relationship: Column, state: str) -> Column:
    """Struct (state, value): the counterpart's value where the relation is SELF (01) and only the counterpart is filled in, else UNKNOWN."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    holds = F.coalesce(relationship == "01", F.lit(False)) & blank(source) & ~blank(counterpart)
    return F.struct(F.when(holds, state).otherwise("UNKNOWN").alias("state"), F.when(holds, counterpart).alias("value"))


def path_text(value: Column, kind: str) -> Column:
    """A nested value, given by its dotted path, as fixed-width text: dates as CCYYMMDD, decimals as whole cents (cut off), null as ''."""
    shown = F.date_format(value, "yyyyMMdd") if kind == "date" else (value * 100).cast("bigint").cast("string") if kind.startswith("decimal") else value.cast("string")
    return F.coalesce(shown, F.lit(""))


def clipped(box: dict[str, Column], width: Column, height: Column) -> Column:
    """Struct (x0, y0, x1, y1) inside the page; null if nothing of the box is."""
    x0, y0, x1, y1 = F.greatest(F.lit(0), box["x0"]), F.greatest(F.lit(0), box["y0"]), F.least(width, box["x1"]), F.least(height, box["y1"])
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def expanded(box: dict[str, Column], width: Column, height: Column, truncated: Column, fraction: float = 0.012, most: float = 0.02) -> Column:
    """Struct of the box, wider by a part of the page (a unit at least, ``most`` of the page at most, half to even) where its edge cuts something off."""
    out = []
    for low, high, size in (("x0", "x1", width), ("y0", "y1", height)):
        by = F.when(F.coalesce(truncated, F.lit(False)), F.least(F.bround(size * most, 0), F.greatest(F.lit(1), F.bround(size * fraction, 0)))).otherwise(F.lit(0)).cast("int")
        out += [F.when(by > 0, F.greatest(F.lit(0), box[low] - by)).otherwise(box[low]).alias(low), F.when(by > 0, F.least(size, box[high] + by)).otherwise(box[high]).alias(high)]
    return F.struct(out[0], out[2], out[1], out[3])
