"""Text, code and money expressions over claim field values. All are Column builders; nothing runs per row in Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: a run of white space of any kind.
WHITE = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def squeezed(raw: Column) -> Column:
    """Runs of white space made one blank, none at the ends."""
    return F.trim(F.regexp_replace(raw, WHITE, " "))


def stripped(raw: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(raw, f"^{WHITE}|{WHITE}$", "")


def normalize_text(raw: Column) -> Column:
    """Trimmed, runs of white space made one space; null when nothing is left."""
    return F.nullif(squeezed(raw), F.lit(""))


def only_digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def digits_of_length(raw: Column, n: int) -> Column:
    """The digits, if there are exactly ``n``; else null."""
    d = only_digits(raw)
    return F.when(F.length(d) == n, d)


def normalize_code(raw: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(raw, r"\s+", "")), F.lit(""))


def normalize_checkbox(raw: Column) -> Column:
    """True for a mark, false for an empty box (or nothing), null for anything else."""
    x = F.upper(stripped(F.coalesce(raw, F.lit(""))))
    return F.when(x.isin("X", "[X]", "YES"), True).when(x.isin("", "[ ]", "NO"), False)


def amount(number: Column) -> Column:
    """A plain number (digits, one point, a minus in front) at cents, half to even; null for other text. Twelve decimals count."""
    fits = number.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.bround(F.when(fits, number).try_cast("decimal(38,12)"), 2).cast("decimal(28,2)")


def amount_text(number: Column) -> Column:
    """The same as text; a negative number that comes to nothing keeps its sign."""
    value = amount(number)
    return F.when((value == 0) & F.startswith(number, F.lit("-")), "-0.00").otherwise(value.cast("string"))


def _number(raw: Column) -> Column:
    """What of a money text is read as a number: all but digits, points and minuses is dropped, parentheses (inside strokes) are a minus."""
    bare = F.regexp_replace(stripped(raw), f"^[|]+{WHITE}|{WHITE}[|]+$|^[|]+|[|]+$", "")
    number = F.regexp_replace(raw, r"[^0-9.\-]", "")
    negative = bare.rlike(r"(?s)^\(.*\)$") & (number != "") & ~F.startswith(number, F.lit("-"))
    return F.when(negative, F.concat(F.lit("-"), number)).otherwise(number)


def money(raw: Column) -> Column:
    """Amount at cents of a money text; null if what is read of it is no number."""
    return amount(_number(raw))


def money_text(raw: Column) -> Column:
    """The same as text."""
    return amount_text(_number(raw))


def strict_money(raw: Column) -> Column:
    """Struct (value, changed) of an amount where only signs of currency, separators and white space may be dropped: digits with at most two decimals, else null."""
    given = F.coalesce(raw, F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(given, "[$,]", ""), WHITE, "")
    nothing = stripped(given) == ""
    return F.struct(F.when(clean.rlike(r"^[0-9]+(\.[0-9]{1,2})?$"), clean).try_cast("decimal(28,2)").alias("value"), (~nothing & (clean != given)).alias("changed"))


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn digits of a string of digits, the last one counted once."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(each, lambda c, i: (c.cast("int") * (1 + i % 2)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))


def valid_npi(npi: Column) -> Column:
    """Ten digits whose Luhn sum with the card issuer prefix 80840 ends in 0; null is not valid."""
    return F.coalesce(F.when(npi.rlike("^[0-9]{10}$"), luhn_sum(F.concat(F.lit("80840"), npi)) % 10 == 0), F.lit(False))


def repair_npi(digits: Column) -> Column:
    """Nine digits with one missing in front: the number, if exactly one leading digit from 1 to 9 makes it valid."""
    fits = F.filter(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda d: F.concat(d.cast("string"), digits)), valid_npi)
    return F.when(digits.rlike("^[0-9]{9}$") & (F.size(fits) == 1), fits[0])


#: Syntaxes of medical codes.
ICD10 = r"^[A-TV-Z][0-9A-Z]{2}(\.?[0-9A-Z]{1,4})?$"
CPT = r"^[0-9]{5}$"
HCPCS = r"^[A-Z][0-9]{4}$"
MODIFIER = r"^[0-9A-Z]{2}$"


def matches_code(raw: Column, syntax: str) -> Column:
    return F.coalesce(F.upper(F.trim(raw)).rlike(syntax), F.lit(False))


def all_codes_match(raw: Column, syntax: str) -> Column:
    """Every part of a field with several codes has the syntax; an empty field has none."""
    parts = F.filter(F.split(F.upper(F.trim(raw)), r"[\s,;]+"), lambda x: x != "")
    return F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike(syntax)), F.lit(False))


def character_error_rate(expected: Column, actual: Column, distance: Callable[[Column, Column], Column] = F.levenshtein) -> Column:
    """Edit distance by expected length; with nothing expected 0 or 1; null counts as empty. For long texts take ``similarity.edit_distance``."""
    e, a = F.coalesce(expected, F.lit("")), F.coalesce(actual, F.lit(""))
    return F.when(F.length(e) == 0, F.when(F.length(a) == 0, 0.0).otherwise(1.0)).otherwise(distance(e, a) / F.length(e))


def firewall(value: Column, labels: Column) -> Column:
    """Whether a value may be one: not empty, and no label that equals or holds it (letter case aside)."""
    v = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return (v != "") & ~F.exists(labels, lambda x: F.contains(F.upper(x), v))


def label_contaminated(field: Column, value: Column) -> Column:
    """All but one of the field name's words (one at least) stand in the value."""
    words = F.array_distinct(F.filter(F.split(F.lower(field), "[^a-z0-9]+"), lambda w: w != ""))
    have = F.split(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+")
    return F.size(F.array_intersect(words, have)) >= F.greatest(F.lit(1), F.size(words) - 1)


def engine_family(engine: Column) -> Column:
    """Engines that share a model family are not independent of each other."""
    e = F.lower(F.coalesce(engine, F.lit("")))
    out = F.lit("other")
    for part, family in (("tess", "tesseract"), ("paddle", "paddle"), ("ppocr", "paddle"), ("rapid", "paddle"), ("trocr", "transformer"), ("azure", "cloud"), ("textract", "cloud")):
        out = F.when(F.contains(e, F.lit(part)), family).otherwise(out)
    return out


def picture_length(picture: Column) -> Column:
    """Characters of a record layout picture: X(n) and 9(n) count n, other symbols one; V counts none."""
    groups = F.regexp_extract_all(picture, F.lit(r"[X9A]\(([0-9]+)\)"), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace(picture, r"[X9A]\([0-9]+\)", ""), r"[^X9A]", "")
    return F.aggregate(groups, F.lit(0), lambda a, n: a + n.cast("int")) + F.length(rest)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_|_$", "")


def person_name(raw: Column) -> Column:
    """Struct of last, first and middle name and suffix: LAST, FIRST MIDDLE with a comma, else FIRST MIDDLE LAST."""
    clean = F.upper(normalize_text(raw))
    suffix = F.regexp_extract(clean, r"[ ,](JR|SR|II|III|IV)\.?$", 1)
    body = F.trim(F.regexp_replace(clean, r"[ ,]+(JR|SR|II|III|IV)\.?$", ""))
    comma = F.contains(body, F.lit(","))
    words = F.filter(F.split(body, r"[\s,]+"), lambda w: w != "")
    n = F.size(words)
    last = F.when(comma, F.get(words, F.lit(0))).otherwise(F.get(words, n - 1))
    first = F.when(comma, F.get(words, F.lit(1))).otherwise(F.when(n > 1, F.get(words, F.lit(0))))
    middle = F.when(n > 2, F.array_join(F.when(comma, F.slice(words, 3, 64)).otherwise(F.slice(words, 2, F.greatest(n - 2, F.lit(0)))), " "))
    return F.struct(last.alias("last"), first.alias("first"), middle.alias("middle"), F.nullif(suffix, F.lit("")).alias("suffix"))


#: Parts of key names whose values are personal.
PERSONAL_KEYS = ("name", "dob", "birth", "ssn", "address", "phone", "email", "member", "patient", "subscriber", "npi", "tax", "account", "policy", "token", "secret", "password", "key")


def redact_map(values: Column, keys: tuple[str, ...] = PERSONAL_KEYS) -> Column:
    """A map of strings with the values of personal keys replaced."""

    def personal(k: Column) -> Column:
        found = F.lit(False)
        for part in keys:
            found = found | F.contains(F.lower(k), F.lit(part))
        return found

    return F.transform_values(values, lambda k, v: F.when(personal(k), F.lit("REDACTED")).otherwise(v))
