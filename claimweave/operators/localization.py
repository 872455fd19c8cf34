"""Where a page's fields stand: anchors by their labels, candidates near them by grid cells, scored boxes and who owns them."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.candidates import type_compatibility
from ..functions.similarity import sequence_ratio
from ..sources.staging import staged
from .policies import region_ownership

#: Datatypes that are read as a run of words on a line.
WORDED = ("PERSON_NAME", "PERSON_OR_ORGANIZATION", "ADDRESS", "TEXT")
#: How far right of a value its box reaches, in heights and in widths; names of fields come before datatypes.
RIGHT_OF_FIELD = {"member_id": (3.75, 0.85)}
RIGHT_OF_TYPE = {"NPI": (3.75, 0.55), "DATE": (2.25, 0.0), "TYPE_OF_BILL": (1.5, 0.0), "CURRENCY": (1.75, 0.0)} | {t: (5.5, 0.9) for t in WORDED}
RIGHT_ELSE = (2.25, 0.0)
#: A value's place relative to its anchor, in parts of the page: centre right of it, or top below it.
RIGHT_REACH = {"from": -0.015, "to": 0.36, "aside": 0.055}
BELOW_REACH = {"from": -0.008, "to": 0.10, "aside": 0.46}
#: Tasks that the tokens of one text are dealt to.
DEALT = 64
#: Size of a grid cell, in parts of the page.
CELL_X, CELL_Y = 0.12, 0.055
#: Weights of the signals.
WEIGHTS = {"anchor": 0.18, "geometry": 0.30, "span": 0.16, "semantic": 0.30, "template": 0.03, "cross_field": 0.03}
#: Letters of a normalised label.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ023456789 "


@dataclass(frozen=True)
class Relation:
    """Where a value stands (``right_of`` or ``below``), and the box it should be in, as parts of the page from the anchor's corner."""

    name: str
    x0: float = 0.0
    y0: float = 0.0
    x1: float = 0.0
    y1: float = 0.0


@dataclass(frozen=True)
class FieldRule:
    """What is known of a field: its labels, where they stand, where the value does, whose labels are near, and its datatype."""

    field: str
    datatype: str
    aliases: tuple[str, ...]
    relations: tuple[Relation, ...]
    zone: str = "ANY"
    neighbours: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ()
    threshold: float = 0.72
    weights: tuple[tuple[str, float], ...] = tuple(WEIGHTS.items())


def normal(text: Column) -> Column:
    """A label's form for comparing: upper case letters, digits and blanks, 1 read as I."""
    return F.trim(F.replace(F.regexp_replace(F.upper(text), "[^A-Z0-9 ]", ""), F.lit("1"), F.lit("I")))


def _normal(text: str) -> str:
    return "".join(c for c in text.upper() if c.isascii() and (c.isalnum() or c == " ")).replace("1", "I").strip()


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9 ]", ""))


def close_labels(texts: DataFrame, text: str, labels: list[tuple[str, str, float]]) -> DataFrame:
    """``text``, label (its number), similarity of all pairs that are alike enough, of normalised texts and (field, label, least) labels.

    Similarity is the matching-blocks ratio of the label and the text, or the
    text's begin of the label's length. It is at most twice the common letters
    over all letters, which expressions count; only pairs that this bound leaves
    open, each different text once, reach Python.
    """
    def count(value: Column) -> Column:
        return F.array(*(F.length(value) - F.length(F.replace(value, F.lit(c), F.lit(""))) for c in _LETTERS))

    def bound(have: Column, size: Column, label: Column) -> Column:
        common = F.aggregate(F.zip_with(have, label["letters"], lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
        return 2.0 * common / (size + F.length(label["label"]))

    rows = [(k, name, least, Counter(name)) for k, (_, name, least) in enumerate(labels)]
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(name).alias("label"), F.lit(least).alias("least"), F.array(*(F.lit(n[c]) for c in _LETTERS)).alias("letters")) for k, name, least, n in rows))
    each = texts.select(text).distinct().filter(F.col(text) != "").withColumn("__n", count(F.col(text)))
    open_ = each.select(text, "__n", F.explode(known).alias("l")).withColumn("__head", F.substring(F.col(text), F.lit(1), F.length("l.label")))
    whole, head = bound(F.col("__n"), F.length(text), F.col("l")), bound(count(F.col("__head")), F.length("__head"), F.col("l"))
    open_ = open_.filter(F.greatest(whole, head) >= F.col("l.least") - 1e-9)
    ratio = F.greatest(sequence_ratio(F.col(text), F.col("l.label")), sequence_ratio(F.col("__head"), F.col("l.label")))
    return open_.select(text, F.col("l.k").alias("label"), F.col("l.least").alias("least"), ratio.alias("similarity")).filter("similarity >= least").drop("least")


def zone_score(zone: Column, cx: Column, cy: Column) -> Column:
    """1 if a centre (in parts of the page) is in the zone, 0.45 if not."""
    across = F.when(cx < 0.4, "LEFT").when(cx > 0.62, "RIGHT").otherwise("MIDDLE")
    down = F.when(cy < 0.4, "UPPER").when(cy > 0.62, "LOWER").otherwise("MIDDLE")
    words = F.split(zone, "_")
    return F.when((zone == "ANY") | (F.array_contains(words, across) & F.array_contains(words, down)), 1.0).otherwise(0.45)


def _rule_table(spark, rules: list[FieldRule]) -> DataFrame:
    """The rules as a table of one row for each field."""
    rows = []
    for r in rules:
        own = tuple({_normal(a): None for a in (*r.aliases, *r.negatives)})
        declared = [_normal(a) for a in (*r.negatives, *(n.replace("_", " ") for n in r.neighbours))]
        wide, width = RIGHT_OF_TYPE[r.datatype] if r.datatype in WORDED else RIGHT_OF_FIELD.get(r.field) or RIGHT_OF_TYPE.get(r.datatype, RIGHT_ELSE)
        weights = dict(r.weights)
        rows.append((
            r.field, r.datatype, r.datatype in WORDED, r.zone, [a.replace(" ", "") for a in own if len(a.replace(" ", "")) >= 3], [_normal(n) for n in r.neighbours], [d for d in declared if d], bool(declared),
            [n for n in map(_normal, r.negatives) if n], [(k, x.name, float(x.x0), float(x.y0), float(x.x1), float(x.y1)) for k, x in enumerate(r.relations)], wide, width, [float(weights[k]) for k in WEIGHTS],
            [a.upper() for a in r.aliases], [a.upper() for a in r.negatives] + [n.replace("_", " ").upper() for n in r.neighbours],
        ))
    schema = """field string, datatype string, worded boolean, zone string, compact array<string>, neighbours array<string>, declared array<string>, has_declared boolean, negatives array<string>,
        relations array<struct<k:int,name:string,x0:double,y0:double,x1:double,y1:double>>, wide double, width_part double, weights array<double>, alias_texts array<string>, foreign_texts array<string>"""
    return spark.createDataFrame(rows, schema)


def _holds(label: Column, text: Column) -> Column:
    return F.contains(label, text) | F.contains(text, label)


def anchors(tokens: DataFrame, rules: list[FieldRule]) -> DataFrame:
    """page, field and the token that is most surely the field's label: anchor (a struct of it) and anchor_score.

    Ties go by the token's place in the page (``ord``), then the label's in the rule.
    """
    labels = [(r.field, _normal(a), r.threshold) for r in rules for a in r.aliases]
    table = _rule_table(tokens.sparkSession, rules)
    named = tokens.withColumn("__normal", normal(F.col("text")))
    close = close_labels(named, "__normal", labels)
    fields = F.array(*(F.lit(f) for f, _, _ in labels))
    # one word may be a good part of all tokens: it is dealt to many tasks, and what it is like to all of them
    close = close.withColumn("field", F.get(fields, F.col("label"))).withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    found = named.withColumn("__deal", F.pmod(F.xxhash64("page", "token"), F.lit(DEALT))).join(close, ["__normal", "__deal"]).join(table.select("field", "zone", F.col("negatives").alias("__negatives")), "field")
    found = found.filter((F.col("confidence") >= 0.45) & ~F.exists("__negatives", lambda n: F.contains(F.col("__normal"), n)))
    zone = zone_score(F.col("zone"), (F.col("x0") + F.col("x1")) / (2 * F.col("width")), (F.col("y0") + F.col("y1")) / (2 * F.col("height")))
    score = F.col("similarity") * (0.8 + 0.2 * zone) * F.col("confidence")
    best = F.min_by(F.struct(*tokens.columns, score.alias("score")), F.struct(-score, "ord", "label"))
    return found.groupBy("page", "field").agg(best.alias("anchor")).withColumn("anchor_score", F.col("anchor.score"))


def _cells(lo_x: Column, hi_x: Column, lo_y: Column, hi_y: Column) -> Column:
    """All grid cells (x, y) of a window given in parts of the page."""
    span = lambda lo, hi, size: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return F.flatten(F.transform(span(lo_x, hi_x, CELL_X), lambda x: F.transform(span(lo_y, hi_y, CELL_Y), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _at(x: Column, y: Column) -> Column:
    return F.struct(F.floor(x / CELL_X).alias("x"), F.floor(y / CELL_Y).alias("y"))


def _geometry(relation: Column, t: str, a: str) -> Column:
    """How well a token ``t`` stands in its relation to an anchor ``a``; 0 out of reach."""
    c = lambda s, k: F.col(f"{s}.{k}")
    width, height = c(a, "width"), c(a, "height")
    tcx, tcy, acx, acy = ((c(s, f"{d}0") + c(s, f"{d}1")) / 2 for s in (t, a) for d in "xy")
    shared = F.greatest(F.lit(0.0), F.least(c(t, "y1"), c(a, "y1")) - F.greatest(c(t, "y0"), c(a, "y0")))
    least = F.least(c(t, "y1") - c(t, "y0"), c(a, "y1") - c(a, "y0"))
    overlap = F.when(least != 0, shared / least).otherwise(0.0)
    late = 0.012 * F.greatest(F.lit(0), c(t, "place") - c(a, "place") - 1)
    bounded = lambda s: F.greatest(F.lit(0.05), F.greatest(F.lit(0.05), F.least(F.lit(1.0), s)) - late)
    dx, dy = tcx - c(a, "x1"), c(t, "y0") - c(a, "y1")
    r, b = RIGHT_REACH, BELOW_REACH
    right = F.when((dx >= r["from"] * width) & (dx <= r["to"] * width) & (F.abs(tcy - acy) <= r["aside"] * height), bounded(0.65 + 0.25 * overlap - 0.35 * F.greatest(F.lit(0.0), dx) / (r["to"] * width)))
    below = F.when((dy >= b["from"] * height) & (dy <= b["to"] * height) & (F.abs(tcx - acx) <= b["aside"] * width), bounded(0.95 - 0.50 * F.greatest(F.lit(0.0), dy) / (b["to"] * height) - 0.20 * F.abs(tcx - acx) / (b["aside"] * width)))
    return F.coalesce(F.when(relation == "right_of", right).otherwise(below), F.lit(0.0))


def nearby(tokens: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """page, field, anchor, t (a token), relation, geometry of all tokens in reach of an anchor that are no label.

    Tokens lie in grid cells and anchors look into those their windows touch: an
    equi-join on page and cell, not all pairs of a page.
    """
    page = lambda c: (F.col(f"t.{c}0") + F.col(f"t.{c}1")) / 2
    width, height = F.col("t.width"), F.col("t.height")
    token = tokens.select("page", F.struct(*tokens.columns).alias("t"))
    places = token.select("page", "t", F.explode(F.array(F.struct(F.lit("right_of").alias("by"), _at(page("x") / width, page("y") / height).alias("cell")), F.struct(F.lit("below").alias("by"), _at(page("x") / width, F.col("t.y0") / height).alias("cell")))).alias("p")).select("page", "t", "p.by", "p.cell")
    a = lambda c: F.col(f"anchor.{c}")
    w, h = a("width"), a("height")
    r, b = RIGHT_REACH, BELOW_REACH
    acx, acy = (a("x0") + a("x1")) / 2, (a("y0") + a("y1")) / 2
    right = _cells(a("x1") / w + r["from"], a("x1") / w + r["to"], acy / h - r["aside"], acy / h + r["aside"])
    below = _cells(acx / w - b["aside"], acx / w + b["aside"], a("y1") / h + b["from"], a("y1") / h + b["to"])
    windows = found.join(rules.select("field", F.explode("relations").alias("relation"), "compact", "neighbours"), "field").withColumn("by", F.when(F.col("relation.name") == "right_of", "right_of").otherwise("below"))
    windows = windows.withColumn("cell", F.explode(F.when(F.col("by") == "right_of", right).otherwise(below)))
    return _no_label(windows.join(places, ["page", "by", "cell"]).filter("t.token <> anchor.token")).withColumn("geometry", _geometry(F.col("relation.name"), "t", "anchor")).filter("geometry > 0").select("page", "field", "anchor", "anchor_score", "t", "relation", "geometry")


def _no_label(rows: DataFrame) -> DataFrame:
    """Rows whose token ``t`` is neither a label of the field nor a neighbour's name."""
    text = normal(F.col("t.text"))
    compact = F.replace(text, F.lit(" "), F.lit(""))
    return rows.filter((compact != "") & ~F.exists("compact", lambda c: _holds(c, compact)) & ~F.array_contains("neighbours", text))


def _grouped(near: DataFrame, rules: DataFrame) -> DataFrame:
    """Values that may be the field's: for worded datatypes runs of up to six words on a line, then every token by itself."""
    kept = ["page", "field", "anchor", "anchor_score"]
    rows = near.join(rules.select("field", "worded"), "field").withColumn("n", F.struct("t.ord", "relation.k"))
    line = Window.partitionBy("page", "field", "t.line").orderBy("t.x0", "n")
    gap = F.col("t.x0") - F.lag("t.x1").over(line)
    height = F.greatest(F.lit(1.0), F.lag("t.y1").over(line) - F.lag("t.y0").over(line))
    runs = rows.filter("worded").withColumn("starts", F.coalesce((gap > 3.5 * height).cast("int"), F.lit(0))).withColumn("run", F.sum("starts").over(line))
    first = F.min("n").over(Window.partitionBy("page", "field", "t.line"))
    runs = runs.withColumn("line_order", first).withColumn("in_run", F.row_number().over(Window.partitionBy("page", "field", "t.line", "run").orderBy("t.x0", "n"))).filter("in_run <= 6")
    word = F.struct("in_run", "t", "geometry", "relation")
    spans = runs.groupBy("page", "field", F.col("t.line").alias("line"), "run").agg(F.array_sort(F.collect_list(word)).alias("w"), F.first("anchor").alias("anchor"), F.first("anchor_score").alias("anchor_score"), F.min("line_order").alias("lo"))
    strongest = F.array_max(F.transform("w", lambda x: F.struct(x["geometry"].alias("g"), (-x["in_run"]).alias("k"), x["relation"].alias("r"))))
    mean = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["geometry"]) / F.size("w")
    spans = spans.select(*kept, F.col("w.t").alias("tokens"), mean.alias("geometry"), strongest["r"].alias("relation"), F.lit("LINE").alias("kind"), F.struct(F.lit(0).alias("k"), F.col("lo").alias("a"), F.col("run").cast("long").alias("b")).alias("order"))
    single = rows.select(*kept, F.array("t").alias("tokens"), "geometry", "relation", F.lit("TOKEN").alias("kind"), F.struct(F.lit(1).alias("k"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).alias("order"))
    return spans.unionByName(single)


def _boxed(groups: DataFrame) -> DataFrame:
    """Adds box: around the tokens with room for what was not read, right of its anchor, short of the next label, within the page."""
    low = lambda c: F.array_min(F.transform("tokens", lambda t: t[c]))
    high = lambda c: F.array_max(F.transform("tokens", lambda t: t[c]))
    tall = F.array_max(F.transform("tokens", lambda t: t["y1"] - t["y0"]))
    rows = groups.withColumn("h", tall).withColumn("right_end", high("x1"))
    x1 = F.col("right_end") + F.greatest(F.col("wide") * F.col("h"), F.col("width_part") * (F.col("right_end") - low("x0")))
    x0 = low("x0") - 0.6 * F.col("h")
    x0 = F.when(F.col("relation.name") == "right_of", F.greatest(x0, F.col("anchor.x1") + 0.1 * F.col("h"))).otherwise(x0)
    rows = rows.withColumns({"bx0": x0, "by0": low("y0") - 0.2 * F.col("h"), "bx1": x1, "by1": high("y1") + 0.8 * F.col("h")})
    blocking = F.filter("label_boxes", lambda b: ~F.array_contains(F.transform("tokens", lambda t: t["token"]), b["token"]) & (b["x0"] >= F.col("right_end")) & (b["y0"] < F.col("by1")) & (b["y1"] > F.col("by0")))
    limit = F.array_min(F.transform(blocking, lambda b: b["x0"] - 0.2 * F.col("h")))
    return rows.withColumn("bx1", F.least("bx1", limit)).withColumn("box", _clipped("bx0", "by0", "bx1", "by1")).drop("bx0", "by0", "bx1", "by1", "h", "right_end")


def _clipped(*sides: str | Column) -> Column:
    whole = [F.bround(F.col(s) if isinstance(s, str) else s, 0).cast("long") for s in sides]
    ends = [F.greatest(F.lit(0), whole[0]), F.greatest(F.lit(0), whole[1]), F.least(F.col("anchor.width").cast("long"), whole[2]), F.least(F.col("anchor.height").cast("long"), whole[3])]
    return F.struct(*(e.alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)))


def weighted(weights: Column, **signals: Column) -> Column:
    """The weighted mean of the signals that are there (not null), 1 at most; 0 if none has weight."""
    order = list(WEIGHTS)
    worth, total = F.lit(0.0), F.lit(0.0)
    for name, value in signals.items():
        weight = F.get(weights, F.lit(order.index(name)))
        worth, total = worth + F.coalesce(weight * value, F.lit(0.0)), total + F.when(value.isNotNull(), weight).otherwise(0.0)
    return F.when(total > 0, F.least(F.lit(1.0), worth / total)).otherwise(0.0)


def _label_boxes(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """page, field, label_boxes: tokens of a page that are labels of the field's neighbours."""
    declared = rules.select("field", "declared").filter(F.size("declared") > 0)
    named = tokens.select("page", "token", "x0", "y0", "x1", "y1", normal(F.col("text")).alias("n"))
    # each token meets the labels (a policy table) where it is: a join by text would gather all tokens of a frequent word in one task
    hits = named.crossJoin(F.broadcast(declared)).filter(F.exists("declared", lambda d: _holds(d, F.col("n"))))
    return hits.groupBy("page", "field").agg(F.collect_list(F.struct("token", "x0", "y0", "x1", "y1")).alias("label_boxes"))


def _contracts(tokens: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """For each anchor and relation the box the rule names, with the token in it that fits best, if there is one."""
    a = lambda c: F.col(f"anchor.{c}")
    side = lambda c, d: a(f"{d}0") + F.col(f"relation.{c}") * a("width" if d == "x" else "height")
    rows = found.join(rules.select("field", "datatype", "compact", "neighbours", F.explode("relations").alias("relation")), "field").withColumn("fallback", _clipped(side("x0", "x"), side("y0", "y"), side("x1", "x"), side("y1", "y")))
    rows = rows.filter("fallback.x1 > fallback.x0 AND fallback.y1 > fallback.y0")
    f = lambda c, d: F.col(f"fallback.{c}") / a(d)
    cells = rows.withColumn("cell", F.explode(_cells(f("x0", "width"), f("x1", "width"), f("y0", "height"), f("y1", "height"))))
    cx, cy = (F.col("t.x0") + F.col("t.x1")) / 2, (F.col("t.y0") + F.col("t.y1")) / 2
    token = tokens.select("page", F.struct(*tokens.columns).alias("t")).withColumn("cell", _at(cx / F.col("t.width"), cy / F.col("t.height")))
    inside = _no_label(cells.join(token, ["page", "cell"]).filter((F.col("t.token") != a("token")) & cx.between(F.col("fallback.x0"), F.col("fallback.x1")) & cy.between(F.col("fallback.y0"), F.col("fallback.y1"))))
    fit = type_compatibility(F.col("t.text"), F.col("datatype"), F.col("field"))
    best = inside.groupBy("page", "field", "relation.k").agg(F.min_by("t", F.struct(-fit, "t.ord")).alias("t"))
    return rows.select("page", "field", "anchor", "anchor_score", "relation", "fallback", F.col("relation.k").alias("k")).join(best, ["page", "field", "k"], "left")


def located_fields(tokens: DataFrame, rules: list[FieldRule], least_score: float = 0.52, ambiguity: float = 0.025) -> DataFrame:
    """page, field, stage, box sides, source, value, score, confidence, ownership, ownership_confidence, wrong_crop of every page and rule.

    ``tokens``: page, token, text, x0, y0, x1, y1, confidence, line, place (in
    reading order), ord (in the page; ties go by it), width, height (of the
    page). A rule's label is found among the page's tokens; values in reach of
    it, and in the box the rule names, are scored by the signals there are; the
    best one is the field's, and what else lies in its box decides who owns it.
    Without a label a field is UNRESOLVED, with one but no value ANCHOR_FOUND.
    Rows of one page meet by grid cell; what is gathered for a field is no more
    than the tokens of its page.
    """
    spark = tokens.sparkSession
    table = _rule_table(spark, rules)
    found = staged(anchors(tokens, rules), "anchors")  # read three times
    near = nearby(tokens, found, table)
    labels = _label_boxes(tokens, table)
    extra = table.select("field", "datatype", "wide", "width_part", "weights", "has_declared")
    none = F.array().cast("array<struct<token:string,x0:double,y0:double,x1:double,y1:double>>")

    def prepared(rows: DataFrame) -> DataFrame:
        return rows.join(extra, "field").join(labels, ["page", "field"], "left").withColumn("label_boxes", F.coalesce("label_boxes", none))

    groups = _boxed(prepared(_grouped(near, table))).filter("box.x1 > box.x0 AND box.y1 > box.y0")
    groups = groups.withColumn("__k", F.row_number().over(Window.partitionBy("page", "field", "box").orderBy("order"))).filter("__k = 1").drop("__k")
    value = F.trim(F.array_join("tokens.text", " "))
    span = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["confidence"]) / F.size("tokens")
    touched = F.exists("label_boxes", lambda b: (F.least(b["x1"], F.col("box.x1")) > F.greatest(b["x0"], F.col("box.x0"))) & (F.least(b["y1"], F.col("box.y1")) > F.greatest(b["y0"], F.col("box.y0"))))
    groups = groups.withColumns({"value": value, "span": span, "cross_field": F.when(F.col("has_declared"), F.when(touched, 0.0).otherwise(1.0)), "direction": F.concat(F.lit("ANCHOR_"), F.upper("relation.name"))})
    groups = staged(groups, "groups")

    contracts = _contracts(tokens, found, table).join(groups.groupBy("page", "field").agg(F.collect_set("box").alias("seen")), ["page", "field"], "left").filter(F.col("seen").isNull() | ~F.array_contains("seen", F.col("fallback")))
    contracts = prepared(contracts.withColumn("tokens", F.filter(F.array("t"), lambda t: t.isNotNull())))
    contracts = _boxed(contracts).withColumns({"value": F.col("t.text"), "span": F.coalesce("t.confidence", F.lit(0.0)), "cross_field": F.lit(None).cast("double"), "geometry": F.lit(0.65), "direction": F.lit("ANCHOR_RELATIVE_CONTRACT"), "kind": F.lit("CONTRACT")})
    fits = type_compatibility(F.col("value"), F.col("datatype"), F.col("field"))
    contracts = contracts.withColumn("box", F.when(fits >= 0.5, F.col("box")).otherwise(F.col("fallback"))).withColumn("order", F.struct(F.lit(2).alias("k"), F.struct(F.col("k").cast("long").alias("ord"), F.col("k").alias("k")).alias("a"), F.lit(0).cast("long").alias("b")))
    shared = ["page", "field", "anchor_score", "datatype", "tokens", "box", "value", "geometry", "span", "cross_field", "direction", "kind", "weights", "order"]
    both = groups.select(*shared).unionByName(contracts.select(*(F.col(c).cast(dict(groups.dtypes)[c]) if c == "order" else F.col(c) for c in shared)))
    both = both.withColumn("semantic", fits).withColumn("score", weighted(F.col("weights"), anchor=F.col("anchor_score"), geometry=F.col("geometry"), span=F.col("span"), semantic=F.col("semantic"), cross_field=F.col("cross_field")))
    fields = ("score", "order", "box", "value", "geometry", "span", "semantic", "cross_field", "direction", "kind", "datatype")
    candidate = F.struct((-F.col("score")).alias("s"), *(F.col(c) for c in fields[1:]), F.col("tokens.token").alias("ids"), "anchor_score")
    ranked = both.groupBy("page", "field").agg(F.array_sort(F.collect_list(candidate)).alias("c"))
    top = F.get("c", F.lit(0))
    rival = F.get(F.filter("c", lambda x: (normal(F.coalesce(x["value"], F.lit(""))) != normal(F.coalesce(top["value"], F.lit("")))) & (F.size(F.array_intersect(x["ids"], top["ids"])) == 0) & (x["direction"] == top["direction"]) & (x["semantic"] >= 0.75)), F.lit(0))
    chosen = ranked.select("page", "field", top.alias("top"), (rival["s"] - top["s"]).alias("margin"))
    owned = _owned(chosen, tokens, table, ambiguity)
    out = found.select("page", "field", "anchor_score").join(owned, ["page", "field"], "left")
    every = tokens.select("page").distinct().crossJoin(F.broadcast(table.select("field"))).join(out, ["page", "field"], "left")  # pages and the rules, a policy table
    contract, score = F.col("top.kind") == "CONTRACT", -F.col("top.s")
    stage = F.when(F.col("anchor_score").isNull(), "UNRESOLVED").when(F.col("top").isNull(), "ANCHOR_FOUND").when(contract, "REGION_GEOMETRY_VALIDATED").when(~F.col("wrong_crop") & (F.col("top.semantic") >= 0.5), "VALUE_SEMANTICALLY_VALIDATED").otherwise("VALUE_SPAN_DETECTED")
    confidence = F.when(F.col("top").isNull(), F.coalesce("anchor_score", F.lit(0.0))).when(contract, F.least("anchor_score", "top.geometry")).otherwise(F.least(score, F.col("anchor_score"), F.col("top.geometry"), F.col("top.span")))
    source = F.when(contract, F.col("top.direction")).otherwise(F.concat(F.col("top.direction"), F.lit("_"), F.col("top.kind"), F.lit("_SPAN")))
    return every.select(
        "page", "field", stage.alias("stage"), *(F.col(f"top.box.{s}").alias(s) for s in ("x0", "y0", "x1", "y1")), source.alias("source"), F.col("top.value").alias("value"), score.alias("score"), confidence.alias("confidence"),
        "ownership", "ownership_confidence", F.coalesce("wrong_crop", F.lit(False)).alias("wrong_crop"), (score < least_score).alias("low_score"),
    )


def _owned(chosen: DataFrame, tokens: DataFrame, rules: DataFrame, ambiguity: float) -> DataFrame:
    """``chosen`` with ownership, ownership_confidence and wrong_crop, by the tokens whose centres lie in the box."""
    b = lambda c: F.col(f"top.box.{c}")
    page = tokens.groupBy("page").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    cells = chosen.join(page, "page").withColumn("cell", F.explode(_cells(b("x0") / F.col("w"), b("x1") / F.col("w"), b("y0") / F.col("h"), b("y1") / F.col("h"))))
    cx, cy = (F.col("t.x0") + F.col("t.x1")) / 2, (F.col("t.y0") + F.col("t.y1")) / 2
    token = tokens.select("page", F.struct(*tokens.columns).alias("t")).withColumn("cell", _at(cx / F.col("t.width"), cy / F.col("t.height")))
    inside = cells.join(token, ["page", "cell"]).filter(cx.between(b("x0"), b("x1")) & cy.between(b("y0"), b("y1"))).join(rules.select("field", "alias_texts", "foreign_texts"), "field")
    text = _plain(F.col("t.text"))
    of = lambda labels: F.exists(F.transform(labels, _plain), lambda x: (x != "") & _holds(x, text))
    extra = ~F.array_contains("top.ids", F.col("t.token")) & (type_compatibility(F.col("t.text"), F.col("top.datatype"), F.col("field")) >= 0.5)
    counts = inside.groupBy("page", "field").agg(F.count_if(of(F.col("foreign_texts"))).alias("foreign"), F.count_if(of(F.col("alias_texts"))).alias("own"), F.count_if(extra).alias("extra"))
    rows = chosen.join(counts, ["page", "field"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    least = F.when(F.col("top.datatype").isin("DATE", "PERSON_NAME", "PERSON_OR_ORGANIZATION"), ambiguity).otherwise(0.005)
    read = F.when(F.trim(F.coalesce("top.value", F.lit(""))) != "", F.size("top.ids")).otherwise(0)
    verdict = region_ownership(zero("foreign"), zero("own"), zero("extra"), F.when(F.col("margin") < least, -1.0), read, F.col("top.geometry"), F.col("top.span"), F.col("top.cross_field"), F.col("top.semantic"), 0.0)
    unread = (F.col("top.kind") == "CONTRACT") & (F.size("top.ids") == 0)
    rows = rows.withColumn("v", verdict).withColumns({"ownership": F.when(unread, "UNKNOWN").otherwise(F.col("v.ownership")), "ownership_confidence": F.when(unread, 0.35).otherwise(F.col("v.confidence"))})
    return rows.withColumn("wrong_crop", F.col("ownership").isin("REGION_AMBIGUOUS", "WRONG_NEIGHBOR", "MULTI_FIELD_CROP", "LABEL_CONTAMINATED")).select("page", "field", "top", "ownership", "ownership_confidence", "wrong_crop")


#: Labels of names, without blanks, that aren't names.
NAME_LABELS = ("PATIENTNAME", "PATIENTSNAME", "INSUREDNAME", "INSUREDSNAME", "BILLINGPROVIDER", "RENDERINGPROVIDER", "REFERRINGPROVIDER", "NAME")
#: Fixed value: how far apart two lines of a name's zone are at least.
LINE_STEP = 12


def name_regions(tokens: DataFrame, fields: DataFrame, zones: DataFrame, labels: tuple[str, ...] = NAME_LABELS) -> DataFrame:
    """page, form, field, value, confidence, outcome, reason and the zone's sides for every row of ``fields`` (page, form, field).

    ``zones``: form, field, x0, y0, x1, y1 in parts of the page, a policy table.
    Of the tokens whose centre is in the zone, labels, numbers and what begins
    with a digit in its first three letters are no names. The line nearest to
    the zone's middle is the value, from left to right (then by reading order);
    of equally near ones the upper. Tokens of a page meet only its own fields.
    """
    size = tokens.groupBy("page").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    asked = fields.select("page", "form", "field").join(zones.withColumnRenamed("x0", "zx0").withColumnRenamed("y0", "zy0").withColumnRenamed("x1", "zx1").withColumnRenamed("y1", "zy1"), ["form", "field"], "left").join(size, "page", "left")
    asked = asked.select("page", "form", "field", *((F.col(f"z{s}") * F.col("w" if s[0] == "x" else "h")).alias(f"b{s}") for s in ("x0", "y0", "x1", "y1")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    letters = F.regexp_replace(F.upper("text"), "[^\\p{L}\\p{N}]", "")
    named = ~letters.isin(*labels) & ~letters.rlike("^[0-9]+$") & ~F.substring(letters, 1, 3).rlike("[0-9]")
    inside = asked.filter("bx0 IS NOT NULL").join(tokens.filter(named), "page").filter(cx.between(F.col("bx0"), F.col("bx1")) & cy.between(F.col("by0"), F.col("by1")))
    each = inside.withColumn("__line", F.bround(cy / LINE_STEP, 0).cast("long")).groupBy("page", "form", "field", "__line").agg(
        F.round(F.abs(F.avg(cy) - F.max((F.col("by0") + F.col("by1")) / 2)), 9).alias("off"), F.array_sort(F.collect_list(F.struct("x0", "place", "ord", F.trim("text").alias("text")))).alias("t"), F.avg("confidence").alias("confidence")
    )
    best = each.groupBy("page", "form", "field").agg(F.min_by(F.struct(F.array_join("t.text", " ").alias("value"), "confidence"), F.struct("off", "__line")).alias("b"))
    out = asked.join(best, ["page", "form", "field"], "left")
    unknown, found = F.col("bx0").isNull(), F.col("b").isNotNull()
    outcome = F.when(unknown, "LOCALIZATION_UNCERTAIN").when(found, "CROP_SAFE").otherwise("EMPTY_CROP")
    reason = F.when(unknown, "NO_STANDARD_NAME_ZONE").when(found, "STANDARD_ZONE_TOKEN_GEOMETRY").otherwise("NO_NAME_TOKEN_IN_VALUE_ZONE")
    return out.select("page", "form", "field", F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"), outcome.alias("outcome"), reason.alias("reason"), *(F.col(f"b{s}").alias(s) for s in ("x0", "y0", "x1", "y1")))
