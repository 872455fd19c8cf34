"""Date expressions: several formats, two-digit years, ranges and filing windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeezed

#: What a part of a date may be, the first that fits.
PARTS = {"Y": "[0-9]{4}", "y": "[0-9]{2}", "m": "1[0-2]|0[1-9]|[1-9]", "d": "3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9]"}
#: Formats in the order they are tried, of field values, of evaluation, of the check of a datatype, and of a birth date's digits.
FIELD_FORMATS = ("m-d-Y", "m/d/Y", "m-d-y", "m/d/y", "Ymd", "mdY", "mdy")
EVALUATION_FORMATS = ("Y-m-d", "m/d/Y", "m-d-Y", "m/d/y", "m-d-y", "Ymd")
DATATYPE_FORMATS = ("m/d/Y", "m-d-Y", "Y-m-d", "m/d/y")
DIGIT_FORMATS = ("mdY", "Ymd", "mdy")


def date_in(text: Column, form: str) -> Column:
    """The date that a text is in one format; null if it isn't one.

    Parts are read from the left, each as long as it may be, and none is read
    anew because of what is left over: 202571 as ``Ymd`` is the first of July.
    Years of two digits from 69 on are of the last century.
    """
    order = [c for c in form if c in PARTS]
    shape = "^(?>" + "".join(f"({PARTS[c]})" if c in PARTS else c for c in form) + r")\z"
    iso = F.regexp_replace(text, shape, "-".join(f"${order.index(c) + 1}" for c in ("Y" if "Y" in order else "y", "m", "d")))
    iso = F.regexp_replace(iso, "^0000| ", "") if "Y" in order else F.concat(F.when(iso >= "69", "19").otherwise("20"), F.replace(iso, F.lit(" "), F.lit("")))
    return F.when(text.rlike(shape), iso.try_cast("date"))


def first_date(text: Column, forms: tuple[str, ...]) -> Column:
    """The date in the first format that fits."""
    return F.coalesce(*(date_in(text, form) for form in forms))


def parse_date(raw: Column) -> Column:
    """A field's date; white space between parts counts as a slash; null if no format fits."""
    return first_date(F.replace(squeezed(raw), F.lit(" "), F.lit("/")), FIELD_FORMATS)


def not_after(day: Column, as_of: Column) -> Column:
    return F.coalesce(day <= as_of, F.lit(False))


def plausible_age(birth: Column, service: Column, most_years: float = 120.0) -> Column:
    """Born on or before the service, and not older than ``most_years`` then."""
    return F.coalesce((birth <= service) & (F.datediff(service, birth) / F.lit(365.25) <= most_years), F.lit(False))


def within_filing_window(service: Column, submitted: Column, days: int = 365) -> Column:
    return F.coalesce(F.datediff(submitted, service).between(0, days), F.lit(False))
