"""Accuracy, confusion, calibration and distribution reports as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


def match_fields(truth: DataFrame, predictions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Truth with its prediction; of several for one key the last by ``order``; predictions without truth are left out."""
    last = predictions.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in predictions.columns if c not in keys]), order).alias("p"))
    return truth.join(last, keys, "left").select(*truth.columns, *(F.col(f"p.{c}").alias(c) for c in predictions.columns if c not in keys))


def accuracy_by(rows: DataFrame, dimensions: list[str], correct: Column) -> DataFrame:
    """dimension, value, n, correct, accuracy: every dimension in one pass, by grouping sets."""
    sets = rows.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))).alias("d"), correct.alias("ok"))
    return sets.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("correct")).withColumn("accuracy", numbers.rate(F.col("correct"), F.col("n")))


def class_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and support of every label that is true or predicted somewhere."""
    both = F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    hit = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False))
    long = rows.select(hit.alias("hit"), F.explode(both).alias("x")).select("hit", "x.*").filter(F.col("label").isNotNull())
    g = long.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.count_if((F.col("t") == 1) & F.col("hit")).alias("tp"))
    return g.select("label", "support", "predicted", "tp", numbers.rate(F.col("tp"), F.col("predicted")).alias("precision"), numbers.rate(F.col("tp"), F.col("support")).alias("recall"))


def cohen_kappa(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """n, agreement and kappa of two raters: 1 if both always gave one label, 0 if chance can't be beaten."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(left) == F.col(right)).cast("double")).alias("agreement"))
    margins = pairs.select(F.explode(F.array(F.struct(F.col(left).alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")), F.struct(F.col(right).alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r")))).alias("x")).groupBy("x.v").agg(F.sum("x.l").alias("l"), F.sum("x.r").alias("r"))
    chance = margins.agg(F.sum((F.col("l") * F.col("r")).cast("decimal(38,0)")).alias("products"))
    out = n.crossJoin(chance)
    expected = F.col("products").cast("double") / (F.col("n").cast("double") * F.col("n").cast("double"))
    kappa = F.when(expected == 1, F.when(F.col("agreement") == 1, 1.0).otherwise(0.0)).otherwise((F.col("agreement") - expected) / (1 - expected))
    return out.select("n", "agreement", kappa.alias("kappa"))


def pareto(rows: DataFrame, category: str) -> DataFrame:
    """Categories by count, with their share and the running share; ties by name. Runs over the counts, a row for each category."""
    counts = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("n").desc(), category)
    total = F.sum("n").over(Window.partitionBy())
    running = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(category, "n", (F.col("n").cast("double") / total).alias("share"), (running.cast("double") / total).alias("cumulative"), F.row_number().over(w).alias("rank"))


def reliability(rows: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """Equal bins of a probability, the last one closed: n, mean probability and part that is right."""
    at = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(probability).cast("decimal(20,10)")).alias("p"), F.sum(F.col(label).cast("long")).alias("right"))


def calibration_error(rows: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """n, Brier score and expected calibration error."""
    table = reliability(rows, probability, label, bins)
    gap = F.abs(F.col("p").cast("double") - F.col("right").cast("double"))
    ece = table.agg(F.sum("n").alias("n"), F.sum(gap.cast("decimal(20,8)")).alias("gaps"))
    d = F.col(probability).cast("decimal(20,10)") - F.col(label)
    brier = rows.agg(F.sum((d * d).cast("decimal(30,12)")).alias("squares"))
    return ece.crossJoin(brier).select("n", (F.col("squares").cast("double") / F.col("n")).alias("brier"), (F.col("gaps").cast("double") / F.col("n")).alias("ece"))


def effect_size(rows: DataFrame, value: str, group: Column, key: list[str]) -> DataFrame:
    """Cohen's d of two groups by pooled sample variance; null where a group has fewer than two or nothing varies."""
    g = rows.groupBy(*key).agg(
        *(f(F.when(group == side, F.col(value).cast("double"))).alias(f"{n}{side}") for side in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)))
    )
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / F.nullif(F.col("n0") + F.col("n1") - 2, F.lit(0)))
    d = F.when((F.col("n0") > 1) & (F.col("n1") > 1) & (pooled > 0), (F.col("m1") - F.col("m0")) / pooled)
    return g.select(*key, "n0", "n1", d.alias("effect"))


def binned_error(rows: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """n and error: the calibration error over half-open bins, weighted by all rows; a probability of 1 is in none of them, but counts."""
    p = F.col(probability)
    at = F.when((p >= 0) & (p < 1), F.floor(p * bins).cast("int"))
    each = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.avg(p).alias("p"), F.avg(F.col(label).cast("double")).alias("y"))
    whole = F.sum("k")
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.col("k") * F.abs(F.col("y") - F.col("p"))))
    return each.agg(whole.alias("n"), (F.coalesce(gap, F.lit(0.0)) / F.greatest(whole, F.lit(1))).alias("error"))
