"""Calibrating scores for many families at once: isotonic and Platt fits, and the choice between them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged

#: Different scores of a range that is pooled in one task, about.
SCORES_EACH = 200_000
#: Newton steps of one job, steps at most, and the largest change of a parameter that counts as settled.
STEPS_EACH, MOST_STEPS, SETTLED = 6, 60, 1e-9
#: What a slope's square costs in the fit (halved), the farthest a parameter goes, and how far in one step.
RIDGE, FARTHEST, FARTHEST_STEP = 1e-3, 40.0, 4.0
#: Rows a family needs for a fit, and for the choice.
LEAST_TRAINED, LEAST_VALIDATED = 10, 2


def equal_scores(rows: DataFrame, key: list[str], score: str, label: str) -> DataFrame:
    """key, score, positives, n: rows of equal score as one; rows without a score or label are left out."""
    s, y = F.col(score).cast("double"), F.col(label).cast("int").cast("double")
    return rows.select(*key, s.alias("score"), y.alias("y")).filter("score IS NOT NULL AND NOT isnan(score) AND y IS NOT NULL").groupBy(*key, "score").agg(F.sum("y").alias("positives"), F.count(F.lit(1)).alias("n"))


def _pooled(key: list[str]):
    """Adjacent blocks whose rates fall made one, over rows in order of key and place; keeps one key's blocks at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*key, "part", "lo", "hi", "positives", "n"]
        held: list[list] = []
        for frame in frames:
            out = []
            for row in frame[columns].itertuples(index=False, name=None):
                of = row[: len(key) + 1]
                if held and tuple(held[-1][: len(of)]) != of and not all(a == b or (a != a and b != b) for a, b in zip(held[-1], of, strict=False)):
                    out += held
                    held = []
                held.append(list(row))
                while len(held) > 1 and held[-2][-2] * held[-1][-1] > held[-1][-2] * held[-2][-1]:
                    last = held.pop()
                    held[-1][-3:] = [last[-3], held[-1][-2] + last[-2], held[-1][-1] + last[-1]]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(held, columns=columns)

    return run


def isotonic_blocks(points: DataFrame, key: list[str], scores_each: int = SCORES_EACH) -> DataFrame:
    """key, lo, hi, positives, n: the blocks of the non-decreasing fit to ``equal_scores`` rows, by adjacent pooling.

    Ranges of key and score are pooled each in a task. Where a range's last
    block is above the next one's first, the two are pooled together; a range
    that is being pooled leaves the one after the next for the following round.
    Pooling what is pooled gives what pooling all at once gives, so the end is
    the exact fit; every round makes ranges fewer. No range is a whole family,
    unless it has few scores.
    """
    blocks = points.select(*key, F.col("score").alias("lo"), F.col("score").alias("hi"), "positives", F.col("n").cast("double").alias("n"))
    blocks = staged(blocks, "points")
    many = max(2, -(-blocks.count() // scores_each))
    ranged = staged(blocks.repartitionByRange(many, *key, "lo").withColumn("part", F.spark_partition_id()), "ranges")
    schema = T.StructType([*ranged.select(*key).schema, *ranged.select("part", "lo", "hi", "positives", "n").schema])
    order = [*key, "part", "lo"]
    now = staged(ranged.repartition("part").sortWithinPartitions("part", *key, "lo").mapInPandas(_pooled(key), schema), "blocks")
    chain = Window.partitionBy(*key).orderBy("part")
    while True:
        ends = now.groupBy(*key, "part").agg(F.min_by(F.struct("positives", "n"), "lo").alias("first"), F.max_by(F.struct("positives", "n"), "lo").alias("last"))
        before = F.lag("last").over(chain)
        falls = F.coalesce(before["positives"] * F.col("first.n") > F.col("first.positives") * before["n"], F.lit(False))
        ends = ends.withColumn("falls", falls).withColumn("run", F.sum((~F.col("falls")).cast("int")).over(chain))  # a run: ranges that fall one after the other
        place = F.row_number().over(Window.partitionBy(*key, "run").orderBy("part")) - 1
        ends = ends.withColumn("joins", F.col("falls") & (place % 2 == 1)).withColumn("target", F.when(F.col("joins"), F.lag("part").over(chain)).otherwise(F.col("part")))
        moves = staged(ends.select(*key, "part", "target", "joins", (F.col("joins") | F.coalesce(F.lead("joins").over(chain), F.lit(False))).alias("again")), "moves")
        if moves.filter("joins").isEmpty():
            return now.drop("part")
        on = [F.col(f"b.{k}").eqNullSafe(F.col(f"m.{k}")) for k in [*key, "part"]]
        joined = on[0]
        for c in on[1:]:
            joined = joined & c
        both = now.alias("b").join(moves.alias("m"), joined).select(*(F.col(f"b.{k}") for k in key), F.col("m.target").alias("part"), "b.lo", "b.hi", "b.positives", "b.n", "m.again")
        again = both.filter("again").drop("again").repartition(*key, "part").sortWithinPartitions(*order).mapInPandas(_pooled(key), schema)
        now = staged(both.filter("NOT again").drop("again").unionByName(again), "blocks")


def isotonic_predictions(points: DataFrame, blocks: DataFrame, key: list[str], scores_each: int = SCORES_EACH) -> DataFrame:
    """``points`` (key, score, ...) with prediction: the block's rate, between blocks the line from one to the next; null for a key without blocks.

    Points and blocks are ordered together in ranges; what the block before a
    range is comes from the ranges' ends, so a key of any size goes over several.
    """
    rate = F.col("positives") / F.col("n")
    marks = blocks.select(*key, F.col("lo").alias("at"), F.struct("lo", "hi", rate.alias("p")).alias("block"))
    given = points.select(*key, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("at"), F.struct(*points.columns).alias("row"))
    both = staged(marks.withColumn("row", F.lit(None).cast(dict(given.dtypes)["row"])).unionByName(given.withColumn("block", F.lit(None).cast(dict(marks.dtypes)["block"]))), "marks")
    many = max(2, -(-both.count() // scores_each))
    ranged = staged(both.repartitionByRange(many, *key, "at").withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*key, "part").orderBy("at", F.col("row").isNotNull())
    last = F.last("block", True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("block", True).over(inside.rowsBetween(1, Window.unboundedFollowing))
    ends = ranged.groupBy(*key, "part").agg(F.max("block").alias("last"), F.min("block").alias("first"))
    chain = Window.partitionBy(*key).orderBy("part")
    ends = ends.select(*(F.col(k).alias(f"__{k}") for k in key), F.col("part").alias("__part"), F.last("last", True).over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", True).over(chain.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    on = F.col("part") == F.col("__part")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = ranged.withColumn("own", last).withColumn("next", after).filter("row IS NOT NULL").join(ends, on)
    a, b, s = F.coalesce("own", "earlier"), F.coalesce("next", "later"), F.col("at")
    line = a["p"] + (s - a["hi"]) * (b["p"] - a["p"]) / (b["lo"] - a["hi"])
    value = F.when(a.isNull(), b["p"]).when((s <= a["hi"]) | b.isNull(), a["p"]).otherwise(line)
    return rows.select("row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("prediction"))


def platt_fits(points: DataFrame, key: list[str]) -> DataFrame:
    """key, slope, intercept, change: the logistic curve of least mean log-loss (and ``RIDGE``) for ``equal_scores`` rows of every key.

    Newton steps for all keys together, each from five sums over the scores: the
    data move once a step as sums, and parameters stay a table of a row for each
    key. Ends when no parameter moves; raises if that takes too many steps.
    Labels that are all alike give a flat curve at the farthest intercept.
    """
    rows = staged(points, "points")
    n, y, s = F.sum("n"), F.sum("positives"), F.sum(F.col("score") * F.col("n"))
    share = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), y / n))
    now = rows.groupBy(*key).agg(F.lit(1.0).alias("slope"), (F.log(share / (1 - share)) - s / n).alias("intercept"), F.lit(1.0).alias("change"))
    hold = lambda x, far: F.greatest(F.lit(-far), F.least(F.lit(far), x))
    for _ in range(0, MOST_STEPS, STEPS_EACH):
        for _ in range(STEPS_EACH):
            z = hold(F.col("slope") * F.col("score") + F.col("intercept"), 30.0)
            p = 1 / (1 + F.exp(-z))
            off, curve, x = F.col("n") * p - F.col("positives"), F.col("n") * p * (1 - p), F.col("score")
            sums = rows.join(now.drop("change"), key).groupBy(*key, "slope", "intercept").agg(F.sum("n").alias("m"), F.sum("positives").alias("y"), F.sum(off * x).alias("gs"), F.sum(off).alias("gi"), F.sum(curve * x * x).alias("hss"), F.sum(curve * x).alias("hsi"), F.sum(curve).alias("hii"))
            c = lambda name: F.col(name) / F.col("m")
            gs, hss, hii = c("gs") + RIDGE * F.col("slope"), c("hss") + RIDGE, c("hii") + 1e-12
            det = hss * hii - c("hsi") * c("hsi")
            ds, di = (hii * gs - c("hsi") * c("gi")) / det, (hss * c("gi") - c("hsi") * gs) / det
            alike = (F.col("y") == 0) | (F.col("y") == F.col("m"))  # a flat curve, as far out as curves go
            slope = F.when(alike, 0.0).otherwise(hold(F.col("slope") - hold(ds, FARTHEST_STEP), FARTHEST))
            intercept = F.when(alike, F.when(F.col("y") == 0, -FARTHEST).otherwise(FARTHEST)).otherwise(hold(F.col("intercept") - hold(di, FARTHEST_STEP), FARTHEST))
            now = sums.select(*key, slope.alias("slope"), intercept.alias("intercept"), F.greatest(F.abs(slope - F.col("slope")), F.abs(intercept - F.col("intercept"))).alias("change"))
        now = staged(now, "platt")
        if (now.agg(F.max("change")).first()[0] or 0.0) <= SETTLED:
            return now
    raise RuntimeError("a Platt fit didn't settle")


def platt_prediction(score: Column, slope: Column, intercept: Column) -> Column:
    return 1 / (1 + F.exp(-(slope * F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)) + intercept)))


def scored(points: DataFrame, key: list[str], probability: Column, bins: int = 10) -> DataFrame:
    """key, brier, ece of ``equal_scores`` rows with a probability: mean squared error, and mean gap of rate and probability over equal bins."""
    p, n, y = probability, F.col("n"), F.col("positives")
    bin_ = sum(((F.col("__p") >= F.lit(k / bins)).cast("int") for k in range(1, bins)), F.lit(0))
    each = points.withColumn("__p", p).groupBy(*key, bin_.alias("bin")).agg(F.sum(n).alias("m"), F.sum(y).alias("y"), F.sum(n * F.col("__p")).alias("p"), F.sum(y * (1 - F.col("__p")) ** 2 + (n - y) * F.col("__p") ** 2).alias("squares"))
    return each.groupBy(*key).agg((F.sum("squares") / F.sum("m")).alias("brier"), (F.sum(F.abs(F.col("y") - F.col("p"))) / F.sum("m")).alias("ece"))


@dataclass
class Calibrators:
    report: DataFrame  # key, status, train, validation, selected, and brier and ece raw and by each curve
    platt: DataFrame  # key, slope, intercept
    isotonic: DataFrame  # key, lo, hi, positives, n


def chosen_calibrators(rows: DataFrame, family: str, score: str, label: str, split: str) -> Calibrators:
    """A calibration curve for each family: fitted on rows of split ``calibration``, chosen on those of ``validation`` by Brier score, then calibration error, then Platt.

    Other splits (a holdout) aren't read. Families with fewer than 10 rows to
    fit or 2 to choose on are INSUFFICIENT_DATA and have no curve. A null family
    is a family named ''. An empty table gives empty tables.
    """
    key = [family]
    named = rows.withColumn(family, F.coalesce(F.col(family).cast("string"), F.lit("")))
    parts = {}
    for name in ("calibration", "validation"):
        parts[name] = staged(equal_scores(named.filter(F.col(split) == name), key, score, label), name)
    counts = [parts[name].groupBy(*key).agg(F.sum("n").alias(short)) for name, short in (("calibration", "train"), ("validation", "validation"))]
    sizes = staged(counts[0].join(counts[1], key, "full").select(*key, F.coalesce("train", F.lit(0)).alias("train"), F.coalesce("validation", F.lit(0)).alias("validation")), "sizes")
    enough = sizes.filter((F.col("train") >= LEAST_TRAINED) & (F.col("validation") >= LEAST_VALIDATED)).select(*key)
    train, held = (parts[name].join(enough, key, "left_semi") for name in ("calibration", "validation"))
    platt, blocks = platt_fits(train, key).drop("change"), isotonic_blocks(train, key)
    out = sizes
    by = {"raw": scored(held, key, F.col("score")), "platt": scored(held.join(platt, key), key, platt_prediction(F.col("score"), F.col("slope"), F.col("intercept"))), "isotonic": scored(isotonic_predictions(held, blocks, key), key, F.col("prediction"))}
    for name, table in by.items():
        out = out.join(table.withColumnsRenamed({"brier": f"{name}_brier", "ece": f"{name}_ece"}), key, "left")
    better = F.struct("isotonic_brier", "isotonic_ece") < F.struct("platt_brier", "platt_ece")
    known = F.col("raw_brier").isNotNull()
    out = out.withColumn("selected", F.when(known, F.when(better, "isotonic").otherwise("platt"))).withColumn("status", F.when(known, "SELECTED").otherwise("INSUFFICIENT_DATA"))
    return Calibrators(out.select(*key, "status", "train", "validation", "selected", *(f"{n}_{m}" for n in by for m in ("brier", "ece"))), platt, blocks)
