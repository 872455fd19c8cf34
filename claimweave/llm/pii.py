"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points looked at before and after a span.
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 24
#: What a context word adds to a span's score.
CONTEXT_GAIN = 0.3
#: Spans of the added kinds below this score are dropped; base spans stay.
LEAST_SCORE = 0.5

#: Matches whose places are added up at once, and code points of a tile of the text: with them, work grows in proportion to matches.
BLOCK, TILE = 256, 512

_SPAN = "array<struct<start:int,end:int,value:string>>"
_SCORED = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """A kind of span. Patterns are possessive, so they need no backtracking on long runs."""

    name: str
    pattern: str
    gate: str  # every text with a span matches it
    score: float
    context: str
    base: bool = True


#: The base patterns and their limits are the contract's. Where
#: a limit drops all shorter matches, it is part of the pattern.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", r"[0-9](?:[\x20-]?[0-9]){13}", 0.7, r"card|visa|credit|payment|debit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"phone|call|tel\b|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", 0.7, r"iban|bank|account|konto|cuenta|compte", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]", 0.3, r"ssn|social|security", False),
    Kind("secret", r"(?i)(?<![a-z])(?:api[_-]?key|access[_-]?key|token|secret|password|passwd)[\"']?[\x20\t]{0,4}[=:][\x20\t]{0,4}[\"']?[A-Za-z0-9_/+-]{16,}+", r"(?i)(?:key|token|secret|passw(?:or)?d)[\"']?[\x20\t]{0,4}[=:]", 0.8, r"secret|private|auth", False),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what a lambda is given isn't computed anew inside it."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: array of (start, end, value) in code points, end exclusive.

    The pieces between the matches have the matches' places: each one starts
    where the lengths before it add up to. They are added up in blocks of
    ``BLOCK`` matches, then over the blocks, so that time and memory follow the
    number of matches.
    """

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["skipped"]
        end = begin + F.length(x["v"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), x["v"].alias("value"))).alias("out"))

    def placed(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["value"].alias("value")))))

    def blocks(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(found) / BLOCK).cast("int") - 1), lambda k: F.aggregate(F.slice(found, k * BLOCK + 1, F.lit(BLOCK)), start, step))

    def zipped(values: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(values))
        return F.zip_with(values, pieces, lambda v, p: F.struct(F.length(p).alias("skipped"), v.alias("v")))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(values, lambda v: F.when(F.size(v) > 0, _let(zipped(v), lambda z: _let(blocks(z), placed))).otherwise(F.array().cast(_SPAN)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """The Luhn checksum of a string of digits."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(each, lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """The ISO 7064 check of an account number: first four characters to the end, letters as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    each = F.filter(F.split(moved, ""), lambda c: c != "")

    def add(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return (F.length(plain) >= 15) & (F.aggregate(each, F.lit(0), add) == 1)


def _confirmed(kind: str, x: Column) -> Column:
    value = x["value"]
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = digits_of(value)
        return (F.length(digits) >= 14) & (F.length(digits) <= 19) & luhn_ok(digits)
    if kind == "phone":
        return F.length(digits_of(value)).between(10, 15)
    if kind == "iban":
        return mod97_ok(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _scored(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind with their score."""

    def cut(tiles: Column, begin: Column, size: Column) -> Column:
        """``size`` code points (no more than a tile has) from ``begin`` on, from the two tiles they are in."""
        tile = F.floor(begin / TILE).cast("int")
        return F.substring(F.concat(F.get(tiles, tile), F.coalesce(F.get(tiles, tile + 1), F.lit(""))), begin % TILE + 1, size)

    def score(x: Column, tiles: Column) -> Column:
        value = x["value"]
        start = x["end"] - F.length(F.regexp_extract(value, "[A-Za-z0-9_/+-]{16,}$", 0)) if kind.name == "secret" else x["start"]
        near = F.concat_ws(" ", cut(tiles, F.greatest(x["start"] - CONTEXT_BEFORE, F.lit(0)), F.least(x["start"], F.lit(CONTEXT_BEFORE))), cut(tiles, x["end"], F.lit(CONTEXT_AFTER)))
        worth = F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.lower(near).rlike(kind.context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0)))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), x["end"].alias("end"), worth.alias("score"))

    tiles = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TILE}}}"), F.lit(0))  # a place in the text is found in its tile, not from the text's begin
    confirmed = F.filter(spans(text, kind.pattern), lambda x: _confirmed(kind.name, x))
    found = _let(confirmed, lambda c: F.when(F.size(c) > 0, _let(tiles, lambda t: F.transform(c, lambda x: score(x, t)))))
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= LEAST_SCORE)
    gate = F.contains(text, F.lit("@")) if kind.gate == "@" else text.rlike(kind.gate)
    none = F.array().cast(_SCORED)
    return F.when(gate, F.coalesce(found.cast(_SCORED), none)).otherwise(none)


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with an added ``pii`` column: spans (start, rank, kind, end, score) by start, then kind. Null text has none.

    One pass of row-wise expressions: nothing is shuffled and repeated rows are
    each looked at; an empty table gives an empty result. Texts are looked at
    whole, however long and however many matches they have: time and memory
    follow both. A column named pii is replaced, all others stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = _let(text, lambda t: F.array_sort(F.concat(*(_scored(t, kind, rank) for rank, kind in enumerate(kinds)))))
    return docs.drop("pii").withColumn("pii", found)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's rows: counts of the base kinds, the digest of base spans, all spans, and their scores."""
    base = [k.name for k in KINDS if k.base]
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "pii")
    pii = F.col("pii")
    return found.select(
        "doc_id",
        *(_count(pii, k) for k in base),
        F.sha2(_listed(F.filter(pii, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _listed(pii).alias("spans"),
        F.array_join(F.transform(pii, lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )
