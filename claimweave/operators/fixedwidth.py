"""Fixed-width records: rendering, reading and checking from a field specification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One field of a record: 1-based start, length, and how it is written."""

    name: str
    start: int
    length: int
    kind: str = "STRING"  # STRING, NUMERIC, DECIMAL_IMPLIED, DATE
    default: str = ""
    align: str = "LEFT"


def render_field(field: Field, raw: Column) -> Column:
    """The field at its length. Empty values take the default; numbers that don't fit are an error, texts are cut."""
    value = F.coalesce(F.nullif(raw.cast("string"), F.lit("")), F.lit(field.default))
    if field.kind in ("NUMERIC", "DECIMAL_IMPLIED"):
        digits = F.regexp_replace(value, "[^0-9]", "")
        too_long = F.raise_error(F.concat(F.lit(f"{field.name}: more than {field.length} digits: "), digits))
        return F.when(F.length(digits) > field.length, too_long.cast("string")).otherwise(F.lpad(digits, field.length, "0"))
    if field.kind == "DATE":
        fits = F.when(F.length(value) == field.length, value).otherwise(F.lit(field.default))
        return F.rpad(fits, field.length, " ")
    cut = F.substring(value, 1, field.length)
    return F.lpad(cut, field.length, " ") if field.align == "RIGHT" else F.rpad(cut, field.length, " ")


def render_record(fields: list[Field], values: dict[str, Column]) -> Column:
    """The fields one after the other, blanks where the specification has gaps."""
    parts, at = [], 1
    for f in sorted(fields, key=lambda f: f.start):
        if f.start > at:
            parts.append(F.lit(" " * (f.start - at)))
        parts.append(render_field(f, values.get(f.name, F.lit(None))))
        at = f.start + f.length
    return F.concat(*parts)


def parse_record(fields: list[Field], line: Column, length: int | None = None) -> Column:
    """Struct of the trimmed fields; null for a line of another length."""
    size = length or max(f.start + f.length - 1 for f in fields)
    return F.when(F.length(line) == size, F.struct(*(F.trim(F.substring(line, f.start, f.length)).alias(f.name) for f in fields)))


def sum_field(lines: DataFrame, column: str, prefix: str, field: Field) -> DataFrame:
    """Sum of a numeric field, in its smallest unit, over lines with the prefix; blank counts as 0."""
    value = F.coalesce(F.nullif(F.trim(F.substring(F.col(column), field.start, field.length)), F.lit("")).try_cast("bigint"), F.lit(0))
    return lines.filter(F.col(column).startswith(prefix)).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def spec_gaps(spec: DataFrame, record: str, start: str, length: str) -> DataFrame:
    """record, position, kind, size: gaps and overlaps between the fields of each record."""
    w = Window.partitionBy(record).orderBy(start, length).rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.max(F.col(start) + F.col(length) - 1).over(w), F.lit(0))
    d = F.col(start) - (F.col("__end") + 1)
    rows = spec.withColumn("__end", end).withColumn("__d", d).filter("__d <> 0")
    return rows.select(record, F.col(start).alias("position"), F.when(F.col("__d") > 0, "GAP").otherwise("OVERLAP").alias("kind"), F.abs("__d").alias("size"))


def file_structure(lines: DataFrame, column: str, lengths: dict[str, int], expected: dict[str, int]) -> DataFrame:
    """prefix, n, wrong_length, expected, ok for every configured or expected record type, and '?' for other lines."""
    spark = lines.sparkSession
    kind = F.lit("?")
    for prefix in reversed(list(lengths)):  # the first configured prefix that matches wins
        kind = F.when(F.col(column).startswith(prefix), prefix).otherwise(kind)
    size = F.element_at(F.create_map(*(F.lit(x) for p in lengths.items() for x in p)), F.col("prefix"))
    counts = lines.select(kind.alias("prefix"), F.col(column).alias("line")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.length("line") != size, F.lit(False))).alias("wrong_length"))
    wanted = spark.createDataFrame(list(expected.items()), "prefix string, expected long")
    out = counts.join(wanted, "prefix", "full").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("wrong_length", F.coalesce("wrong_length", F.lit(0)))
    ok = (F.col("wrong_length") == 0) & (F.col("prefix") != "?") & F.coalesce(F.col("n") == F.col("expected"), F.lit(True))
    return out.select("prefix", "n", "wrong_length", "expected", ok.alias("ok"))


def parse_spec_text(lines: DataFrame, source: str, number: str, column: str) -> DataFrame:
    """source, record, name, start, length, kind, clear: fields of record layouts written as text.

    A line ``RECORD <type>`` begins a record, ``<name> <start>-<end> <picture>``
    is a field of the record begun last; other lines are passed over. ``clear``
    is false where picture and positions disagree, or no record has begun.
    """
    from ..functions.text import picture_length

    head, field = r"^\s*RECORD\s+([A-Z0-9]+)\s*$", r"^\s*([A-Za-z][A-Za-z0-9_ ]*?)\s+([0-9]+)-([0-9]+)\s+([X9A][0-9X9AV()]*)\s*$"
    begun = F.last(F.nullif(F.regexp_extract(column, head, 1), F.lit("")), ignorenulls=True).over(Window.partitionBy(source).orderBy(number))
    rows = lines.withColumn("record", begun).filter(F.col(column).rlike(field))
    part = lambda k: F.regexp_extract(column, field, k)
    size = part(3).cast("int") - part(2).cast("int") + 1
    return rows.select(
        source, "record", F.lower(F.regexp_replace(part(1), " +", "_")).alias("name"), part(2).cast("int").alias("start"), size.alias("length"),
        F.when(F.contains(part(4), F.lit("V")), "DECIMAL_IMPLIED").when(part(4).startswith("9"), "NUMERIC").otherwise("STRING").alias("kind"),
        (F.col("record").isNotNull() & (picture_length(part(4)) == size)).alias("clear"),
    )


def merged_sections(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, issues) of record layouts whose sections go on over pages and repeat their headings.

    ``fields``: source, line (in the text), record, number (of the field), name,
    start, end, picture and further columns, a row for each mention. The first
    mention of a field in its record stands; a later one that says something
    else of its place or picture is an issue, at its own line. A field without a
    number is one of its own.
    """
    key = ["source", "record", "number"]
    place = F.struct("start", "end", "picture")
    first = fields.filter("number IS NOT NULL").groupBy(*key).agg(F.min("line").alias("__line"), F.min_by(place, "line").alias("__place"))
    known = fields.join(first, key, "left")
    kept = known.filter("number IS NULL OR line = __line").select(*fields.columns)
    differs = known.filter(F.col("number").isNotNull() & (F.col("line") > F.col("__line")) & (place != F.col("__place")))
    message = F.concat(F.lit("defined as "), F.col("__place.start").cast("string"), F.lit("-"), F.col("__place.end").cast("string"), F.lit(", then as "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return kept, differs.select("source", "record", "number", F.lit("duplicate_field_conflict").alias("code"), F.lit("ERROR").alias("severity"), message.alias("message"), "line")


def spec_issues(fields: DataFrame, records: DataFrame) -> DataFrame:
    """source, record, number, code, severity, message of all that is wrong with record layouts, each once.

    ``fields``: source, record, number, name, start, end, picture, requirement,
    notes; ``records``: source, record, length, a row for each definition. Fields
    of a record are compared with the farthest end of those before them, in order
    of start, so one pass over sorted fields finds gaps and overlaps, also of
    fields that lie in others.
    """
    from ..functions.text import picture_length

    issue = lambda rows, code, message, severity="ERROR", number="number": rows.select("source", "record", F.col(number).alias("number") if number else F.lit(None).cast("string").alias("number"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    defined = records.groupBy("source", "record").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("length"))
    order = Window.partitionBy("source", "record").orderBy("start", "end", "number")
    seen = Window.partitionBy("source", "record", "number").orderBy("start", "end")
    rows = fields.withColumn("number", text("number")).withColumn("__next", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).withColumn("__k", F.row_number().over(seen))
    last = fields.groupBy("source", "record").agg(F.max("end").alias("__end")).join(defined, ["source", "record"], "right").withColumn("__end", F.coalesce("__end", F.lit(0)))
    size = F.col("end") - F.col("start") + 1
    digits = F.upper("picture").rlike(r"(^|PIC\s*)[9S]")
    said = F.lower(F.coalesce("notes", F.lit("")))
    out = [
        issue(defined.filter("n > 1"), "duplicate_record", F.lit("record type appears more than once"), number=None),
        issue(rows.filter(F.col("number").isNotNull() & (F.col("__k") > 1)), "duplicate_field", F.lit("duplicate field number")),
        issue(rows.filter("start > __next"), "unexplained_gap", F.concat(F.lit("unmapped positions "), text("__next"), F.lit("-"), text(F.col("start") - 1)), "WARNING"),
        issue(rows.filter("start < __next"), "overlapping_field", F.concat(F.lit("starts at "), text("start"), F.lit(" where "), text("__next"), F.lit(" is free"))),
        issue(rows.filter(F.coalesce(picture_length(F.col("picture")) != size, F.lit(False))), "picture_length_mismatch", F.concat(F.lit("picture of "), text(picture_length(F.col("picture"))), F.lit(" in "), text(size))),
        issue(rows.filter((F.col("requirement") == "R") & (F.trim(F.coalesce("name", F.lit(""))) == "")), "required_field_without_name", F.lit("required field has no name")),
        issue(rows.filter(digits & (F.contains(said, F.lit("left justify")) | F.contains(said, F.lit("blank fill")))), "numeric_format_conflict", F.lit("numeric picture with left or blank formatting"), "WARNING"),
        issue(last.filter("__end < length"), "unexplained_gap", F.concat(F.lit("unmapped positions "), text(F.col("__end") + 1), F.lit("-"), text("length")), "WARNING", None),
        issue(last.filter("__end > length"), "record_overflow", F.concat(F.lit("fields extend to "), text("__end"), F.lit(", expected "), text("length")), number=None),
    ]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.distinct()
