"""Field-specific rules: evaluation normalisers, datatypes, spans, addresses, repairs, sentinels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, text

#: Shapes of datatypes; blanks don't count.
DATATYPES = {
    "MONEY": r"\$?[0-9][0-9,]*(?:\.[0-9]{2})?", "NPI": "[0-9]{10}", "MEMBER_ID": "(?i)[A-Z0-9][A-Z0-9-]{4,24}", "TAX_ID": "[0-9]{2}-?[0-9]{7}", "CPT_HCPCS": "(?i)(?:[0-9]{5}|[A-Z][0-9]{4})", "ICD": r"(?i)[A-TV-Z][0-9]{2}(?:\.?[A-Z0-9]{1,4})?",
    "REVENUE_CODE": "[0-9]{4}", "TYPE_OF_BILL": "[0-9]{3,4}", "INTEGER": "[0-9]+",
}
#: What a field's name holds, by the way its values are compared.
COMPARED_AS = {
    "amount": ("charge", "amount", "paid", "rate"), "digits": ("date", "dob"),
    "letters": ("name", "address", "member", "insured_id", "subscriber_id", "npi", "diagnos", "icd", "code", "tax", "bill", "zip", "postal"),
}
#: What a table column's name holds, by the kind of its cells.
CELL_KINDS = {"NPI_DIGITS": ("npi",), "CODE_CASE_SPACE": ("revenue", "procedure", "diagnosis"), "VALID_DATE_ISO": ("date",), "CURRENCY_EVIDENCE": ("amount", "charge", "currency", "adjustment", "paid")}


def named_any(name: Column, parts: tuple[str, ...]) -> Column:
    """Whether a name holds one of the parts, letter case aside."""
    return F.coalesce(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(name), p)), F.lit(False))


def valid_datatype(value: Column, kind: Column) -> Column:
    """Whether a value, without colons at its ends, has the form of its datatype: a date, a name of two to six words, any text, or a shape."""
    v = F.regexp_replace(text.stripped(value), "^:+|:+$", "")
    words = F.size(F.regexp_extract_all(v, F.lit("[A-Za-z][A-Za-z'.-]+"), F.lit(0)))
    out = F.when(kind == "DATE", dates.first_date(v, dates.DATATYPE_FORMATS).isNotNull()).when(kind == "NAME", words.between(2, 6)).when(kind.isin("TEXT", "ADDRESS"), v != "")
    shapes = "|".join(f"{name}:(?:{shape})" for name, shape in DATATYPES.items())
    shaped = F.concat(kind, F.lit(":"), F.replace(v, F.lit(" "), F.lit(""))).rlike(rf"^(?:{shapes})\z")
    return F.coalesce(out.otherwise(shaped), F.lit(False))


def evaluation_form(value: Column, rule: Column) -> Column:
    """A value as evaluation compares it; a date that doesn't parse stays as it is, an amount without its other characters.

    Nothing is null; an identifier with no letter or digit is the empty text.
    """
    up, clean = F.upper(value), text.normalize_text(value)
    none = lambda x: F.nullif(x, F.lit(""))
    number = none(F.regexp_replace(value, r"[^0-9.\-]", ""))
    return (
        F.when(rule == "identifier", F.when(value != "", F.regexp_replace(up, "[^A-Z0-9]", ""))).when(rule == "digits", none(text.only_digits(value))).when(rule == "code", none(F.regexp_replace(up, "[^A-Z0-9.]", "")))
        .when(rule == "date", F.coalesce(dates.first_date(clean, dates.EVALUATION_FORMATS).cast("string"), clean)).when(rule == "amount", F.coalesce(text.amount_text(number), number)).otherwise(clean)
    )


def plain_number(number: Column) -> Column:
    """A number without zeros that say nothing; null if the text isn't one."""
    shape = r"^(-?)0*([0-9]*)(?:\.([0-9]*?)0*)?$"
    whole, part = F.regexp_extract(number, shape, 2), F.regexp_extract(number, shape, 3)
    out = F.concat(F.regexp_extract(number, shape, 1), F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(number.rlike(shape) & number.rlike("[0-9]"), out)


def agreement_form(field: Column, value: Column) -> Column:
    """A value as two readings of a field are compared: amounts without idle zeros, dates as digits, names and codes squeezed; null is empty."""
    up = F.upper(text.stripped(F.coalesce(value, F.lit(""))))
    number = F.translate(F.regexp_replace(up, "[^0-9.()-]", ""), "()", "-")
    return (
        F.when(named_any(field, COMPARED_AS["amount"]), F.coalesce(plain_number(number), up)).when(named_any(field, COMPARED_AS["digits"]), text.only_digits(up))
        .when(named_any(field, COMPARED_AS["letters"]), F.regexp_replace(up, "[^A-Z0-9]", "")).otherwise(text.squeezed(up))
    )


def last_match(value: Column, shape: str, preferred_last: bool) -> Column:
    """Of several matches of a shape in a text the first, or the last; null without one."""
    found = F.regexp_extract_all(value, F.lit(f"({shape})"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1 if preferred_last else 1))


def ocr_digits(value: Column) -> Column:
    """Letters that stand for digits in OCR output, put right."""
    return F.translate(F.upper(value), "OQDILZSGB", "000112568")


def address_block(lines: Column) -> Column:
    """Struct of street, unit, city, state and zip from an array of lines; a line 'CITY, ST 12345' sets the last three."""
    shape = r"^(.+?),? +([A-Z]{2}) +([0-9]{5}(?:-[0-9]{4})?)$"
    clean = F.filter(F.transform(lines, lambda x: F.upper(F.trim(x))), lambda x: (x != "") & ~x.rlike("^(ADDRESS|CITY|STATE|ZIP)\\b"))
    places, rest = F.filter(clean, lambda x: x.rlike(shape)), F.filter(clean, lambda x: ~x.rlike(shape))
    place = F.when(F.size(places) > 0, F.element_at(places, -1))
    part = lambda k: F.nullif(F.regexp_extract(place, shape, k), F.lit(""))
    return F.struct(F.get(rest, F.lit(0)).alias("street"), F.get(rest, F.lit(1)).alias("unit"), part(1).alias("city"), part(2).alias("state"), part(3).alias("zip"), place.isNotNull().alias("complete"))


#: What each semantic state is written as.
SENTINELS = {"SAME_AS_PATIENT": "SAME", "NOT_APPLICABLE": "N/A", "NONE": "NONE", "SIGNATURE_ON_FILE": "SOF"}


def sentinel(state: Column, value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, shown in SENTINELS.items():
        out = F.when(state == name, shown).otherwise(out)
    return F.coalesce(out, value)


def zone_score(cx: Column, cy: Column, zone: tuple[float, float, float, float], near: float = 0.08) -> Column:
    """1 inside a zone of the page, 0.65 close to it, else 0."""

    def within(pad: float) -> Column:
        return (cx >= zone[0] - pad) & (cx <= zone[2] + pad) & (cy >= zone[1] - pad) & (cy <= zone[3] + pad)

    return F.when(within(0.0), 1.0).when(within(near), 0.65).otherwise(0.0)


def region_outcome(iou: Column, held: Column, empty: Column, neighbour: Column) -> Column:
    """What a predicted region turned out to be."""
    return F.when(empty, "EMPTY").when(neighbour, "WRONG_NEIGHBOUR").when((held >= 0.95) & (iou >= 0.5), "EXACT").when(held >= 0.95, "TOO_WIDE").when(held >= 0.5, "PARTIAL").when(iou > 0, "SHIFTED").otherwise("MISSED")


def fold_hash(values: Column, bins: int) -> Column:
    """Array summed into ``bins`` bins of integer edges and scaled to length 1; all zero stays so."""
    n = F.size(values)
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda k: F.aggregate(F.slice(values, F.floor(k * n / bins).cast("int") + 1, (F.floor((k + 1) * n / bins) - F.floor(k * n / bins)).cast("int")), F.lit(0.0), lambda a, v: a + v.cast("double")),
    )
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(sums, lambda v: F.when(norm > 0, v / norm).otherwise(0.0))


#: Characters that OCR takes for each other.
CONFUSABLE = {"0": "O", "1": "I", "2": "Z", "5": "S", "6": "G", "8": "B", "B": "8", "G": "6", "I": "1", "L": "1", "O": "0", "S": "5", "Z": "2"}


def confusable_alternatives(value: Column, swaps: int = 2) -> Column:
    """The value with up to ``swaps`` of its confusable characters exchanged, without repeats: none, one, two."""
    chars = F.filter(F.split(F.upper(value), ""), lambda c: c != "")
    pairs = F.create_map(*(F.lit(x) for kv in CONFUSABLE.items() for x in kv))
    places = F.filter(F.transform(chars, lambda c, i: F.struct(i.alias("i"), F.try_element_at(pairs, c).alias("to"))), lambda p: p["to"].isNotNull())

    def swapped(text_: Column, place: Column) -> Column:
        return F.overlay(text_, place["to"], place["i"] + 1, 1)

    found = F.array(F.upper(value))
    levels = [F.transform(places, lambda p: F.struct(p["i"].alias("last"), swapped(F.upper(value), p).alias("v")))]
    for _ in range(swaps - 1):
        levels.append(F.flatten(F.transform(levels[-1], lambda s: F.transform(F.filter(places, lambda p: p["i"] > s["last"]), lambda p: F.struct(p["i"].alias("last"), swapped(s["v"], p).alias("v"))))))
    for level in levels:
        found = F.concat(found, F.transform(level, lambda s: s["v"]))
    return F.array_distinct(found)


def transformed_box(box: list[Column], h: list[float]) -> Column:
    """Struct (x0, y0, x1, y1, convex): the box around a box's corners under a 3 x 3 homography given by rows."""
    corners = [(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]
    moved = []
    for x, y in corners:
        w = x * h[6] + y * h[7] + h[8]
        moved.append(((x * h[0] + y * h[1] + h[2]) / w, (x * h[3] + y * h[4] + h[5]) / w))
    turns = []
    for k in range(4):
        (ax, ay), (bx, by), (cx, cy) = moved[k], moved[(k + 1) % 4], moved[(k + 2) % 4]
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    convex = F.lit(True)
    for t in turns:
        convex = convex & (t > 0)
    xs, ys = [m[0] for m in moved], [m[1] for m in moved]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"), convex.alias("convex"))


def table_cell(raw: Column, column: Column) -> Column:
    """Struct (value, change, status, acceptable) of a table cell by what its column's name says: number of a provider, code, date, amount or text.

    What doesn't have its column's form stays as it is, but for white space
    (codes also for letter case). Only valid cells of a known kind are
    acceptable. Null is blank.
    """
    kind = F.lit("WHITESPACE_ONLY")
    for name, parts in reversed(CELL_KINDS.items()):
        kind = F.when(named_any(column, parts), name).otherwise(kind)
    is_diagnosis = named_any(column, ("diagnosis",))

    def checked(c: Column) -> Column:
        v, digits = c["v"], text.only_digits(c["v"])
        code = F.replace(F.upper(v), F.lit(" "), F.lit(""))
        code = F.when(is_diagnosis, F.rtrim(code, F.lit("."))).otherwise(code)
        form = F.when(c["kind"] == "NPI_DIGITS", F.when(text.valid_npi(digits), digits)).when(c["kind"] == "CODE_CASE_SPACE", F.when(code.rlike("^[A-Z0-9.]{2,10}$"), code)).when(c["kind"] == "VALID_DATE_ISO", _cell_date(v)).when(c["kind"] == "CURRENCY_EVIDENCE", _cell_amount(v))
        return F.struct(v.alias("v"), c["kind"].alias("kind"), form.alias("form"), F.when(c["kind"] == "CODE_CASE_SPACE", code).otherwise(v).alias("kept"))

    def told(c: Column) -> Column:
        status = F.when(c["v"] == "", "VALID_BLANK").when(c["kind"] == "WHITESPACE_ONLY", "NOT_APPLICABLE").when(c["form"].isNull(), "INVALID").otherwise("VALID")
        value, change = F.when(c["v"] == "", "").otherwise(F.coalesce(c["form"], c["kept"])), F.when(c["v"] == "", "PRESERVE_BLANK").otherwise(c["kind"])
        return F.struct(value.alias("value"), change.alias("change"), status.alias("status"), (status == "VALID").alias("acceptable"))

    return _once(_once(F.struct(F.coalesce(text.squeezed(raw), F.lit("")).alias("v"), kind.alias("kind")), checked), told)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _cell_date(v: Column) -> Column:
    """A day of a month of a year as an ISO date; null for other text."""
    shape = r"^([0-9]{1,2})[ /-]([0-9]{1,2})[ /-]([0-9]{2}|[0-9]{4})$"
    part = [F.regexp_extract(v, shape, k).try_cast("int") for k in (1, 2, 3)]
    year = F.when(part[2] < 100, part[2] + 2000).otherwise(part[2])
    day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), part[0].cast("string"), part[1].cast("string")).try_cast("date").cast("string")
    return F.when(v.rlike(shape), day)


def _cell_amount(v: Column) -> Column:
    """An amount without signs and separators, in parentheses a negative one; null for other text."""
    bare = F.trim(F.trim(v, F.lit("|")))
    negative = bare.rlike(r"^\(.*\)$")
    shown = F.when(negative, F.regexp_extract(bare, r"^\((.*)\)$", 1)).otherwise(bare)
    return F.when(shown.rlike(r"^\$? *[0-9][0-9,]*(?:\.[0-9]{2})?$"), F.concat(F.when(negative, "-").otherwise(""), F.regexp_replace(shown, "[$ ,]", "")))


def cell_faults(box: list[Column], page: Column, indexes: list[Column], confidence: Column, digest: Column, status: Column, acceptable: Column) -> Column:
    """What is wrong with a table cell's record, as names in order: a box (x0, y0, x1, y1) without area, a page below 1, a negative index, a confidence outside 0 to 1, a digest that isn't one, or a cell for review only that may be accepted unseen. What isn't known is wrong, but for ``status`` (then REVIEW_ONLY) and ``acceptable`` (then not)."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    placed = F.lit(True)
    for index in indexes:
        placed = placed & (index >= 0)
    checks = (
        (holds((box[2] > box[0]) & (box[3] > box[1])), "BOX_WITHOUT_AREA"), (holds(page >= 1), "PAGE_NOT_VALID"), (holds(placed), "INDEX_NOT_VALID"), (holds(confidence.between(0, 1)), "CONFIDENCE_NOT_VALID"), (holds(digest.rlike(r"^[0-9a-f]{64}\z")), "DIGEST_NOT_VALID"),
        (~(holds(acceptable) & (F.coalesce(status, F.lit("REVIEW_ONLY")) == "REVIEW_ONLY")), "REVIEW_ONLY_IS_NEVER_AUTOMATIC"),
    )
    return F.array_compact(F.array(*(F.when(~good, F.lit(name)) for good, name in checks)))


def fused_tokens(a: Column, b: Column, vocabulary: Column) -> Column:
    """Two readings of a text made one, word by word; null if their words can't be matched up.

    Equal words stay. Where they differ, a word of the vocabulary at one edit
    from both is taken (the first by name), else the first reading's word if the
    two are at most two edits apart.
    """
    x, y = F.split(a, " "), F.split(b, " ")

    def choose(p: Column, q: Column) -> Column:
        near = F.filter(F.array_sort(vocabulary), lambda v: (F.levenshtein(v, p) <= 1) & (F.levenshtein(v, q) <= 1))
        return F.when(p == q, p).when(F.size(near) > 0, F.get(near, F.lit(0))).when(F.levenshtein(p, q) <= 2, p)

    fused = F.zip_with(x, y, choose)
    return F.when((F.size(x) == F.size(y)) & ~F.exists(fused, lambda w: w.isNull()), F.array_join(fused, " "))
