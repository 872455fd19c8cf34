"""Evaluation: accuracy, confusion, agreement, calibration, outcomes, errors and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.similarity import edit_distance
from ..operators import calibration, metrics
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

# Extracted fields stand in as lines: the return flag is the truth, a flag that
# depends on the supplier and discount the prediction.
_FIELD_SQL = """f AS (SELECT l_orderkey AS document, l_linenumber AS field, l_returnflag AS truth, CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_discount >= 0.09 THEN 'A' ELSE l_returnflag END AS predicted, l_linestatus AS method,
  CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'mid' ELSE 'high' END AS quality, 1 - l_discount AS confidence, l_suppkey AS engine FROM lineitem)"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = F.when(F.col("l_suppkey") % 9 == 0, None).when(F.col("l_discount") >= 0.09, "A").otherwise(F.col("l_returnflag"))
    quality = F.when(F.col("l_quantity") < 17, "low").when(F.col("l_quantity") < 34, "mid").otherwise("high")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("field"), F.col("l_returnflag").alias("truth"), predicted.alias("predicted"),
        F.col("l_linestatus").alias("method"), quality.alias("quality"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_suppkey").alias("engine"),
    )


def _right():
    return F.coalesce(F.col("truth"), F.lit("")) == F.coalesce(F.col("predicted"), F.lit(""))


@query(f"""WITH {_FIELD_SQL}, d AS (SELECT document, bool_and(coalesce(truth, '') = coalesce(predicted, '')) AS perfect FROM f GROUP BY 1)
SELECT count(*) AS n_fields, CAST(count(*) FILTER (WHERE coalesce(truth, '') = coalesce(predicted, '')) AS DOUBLE) / count(*) AS exact, CAST(count(*) FILTER (WHERE predicted IS NULL) AS DOUBLE) / count(*) AS missing, (SELECT CAST(count(*) FILTER (WHERE perfect) AS DOUBLE) / count(*) FROM d) AS perfect_documents FROM f""")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match over fields and over whole documents."""
    per = _fields(spark, sf_dir).groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.count_if(_right()).alias("ok"), F.count_if(F.col("predicted").isNull()).alias("none"))
    return per.agg(
        F.sum("n").alias("n_fields"), numbers.rate(F.sum("ok"), F.sum("n")).alias("exact"), numbers.rate(F.sum("none"), F.sum("n")).alias("missing"), numbers.rate(F.count_if(F.col("ok") == F.col("n")), F.count(F.lit(1))).alias("perfect_documents")
    )


@query(f"""WITH {_FIELD_SQL}, g AS (SELECT CASE WHEN grouping(method) = 0 THEN 'method' WHEN grouping(quality) = 0 THEN 'quality' WHEN grouping(field) = 0 THEN 'field' ELSE 'truth' END AS dimension, coalesce(CAST(field AS VARCHAR), method, quality, truth) AS value, count(*) AS n, count(*) FILTER (WHERE coalesce(truth, '') = coalesce(predicted, '')) AS correct FROM f GROUP BY GROUPING SETS ((field), (method), (quality), (truth)))
SELECT dimension, value, n, correct, CAST(correct AS DOUBLE) / n AS accuracy FROM g""")
def accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy_by(_fields(spark, sf_dir), ["field", "method", "quality", "truth"], _right())


@query(f"WITH {_FIELD_SQL} SELECT truth, coalesce(predicted, 'NONE') AS predicted, count(*) AS n FROM f GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).groupBy("truth", F.coalesce("predicted", F.lit("NONE")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FIELD_SQL}, x AS (SELECT truth AS label, 1 AS t, 0 AS p, truth = predicted AS hit FROM f UNION ALL SELECT predicted, 0, 1, truth = predicted FROM f), g AS (SELECT label, sum(t) AS support, sum(p) AS predicted, count(*) FILTER (WHERE t = 1 AND hit) AS tp FROM x WHERE label IS NOT NULL GROUP BY 1)
SELECT label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, tp, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(predicted AS DOUBLE) END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) END AS recall FROM g""")
def class_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_metrics(_fields(spark, sf_dir), "truth", "predicted")


@query("""WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), m AS (SELECT v, sum(l) AS l, sum(r) AS r FROM (SELECT a AS v, 1 AS l, 0 AS r FROM p UNION ALL SELECT b, 0, 1 FROM p) GROUP BY v),
s AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS agreement FROM p), e AS (SELECT CAST(sum(l * r) AS DOUBLE) AS products FROM m)
SELECT n, agreement, CASE WHEN products / (n * n) = 1 THEN CASE WHEN agreement = 1 THEN 1.0 ELSE 0.0 END ELSE (agreement - products / (n * n)) / (1 - products / (n * n)) END AS kappa FROM s, e""")
def kappa_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two review labels of one document as two raters."""
    return metrics.cohen_kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b")


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY 1)
SELECT event_type, n, CAST(n AS DOUBLE) / sum(n) OVER () AS share, CAST(sum(n) OVER (ORDER BY n DESC, event_type ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER () AS cumulative, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS INTEGER) AS rank FROM c""")
def error_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pareto(table(spark, sf_dir, "events").filter("value > 20"), "event_type")


@query(f"""WITH {_FIELD_SQL}, b AS (SELECT least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin, count(*) AS n, sum(CAST(confidence AS DECIMAL(20,10))) AS p, count(*) FILTER (WHERE truth = predicted) AS r FROM f GROUP BY 1)
SELECT bin, n, CAST(p AS DOUBLE) / n AS confidence, CAST(r AS DOUBLE) / n AS accuracy FROM b""")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fields(spark, sf_dir).withColumn("right", (_right() & F.col("predicted").isNotNull()).cast("int"))
    return metrics.reliability(rows, "confidence", "right").select("bin", "n", (F.col("p").cast("double") / F.col("n")).alias("confidence"), (F.col("right").cast("double") / F.col("n")).alias("accuracy"))


@query(f"""WITH {_FIELD_SQL}, x AS (SELECT CAST(confidence AS DECIMAL(20,10)) AS p, CASE WHEN truth = predicted THEN 1 ELSE 0 END AS y, confidence FROM f), b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, sum(p) AS p, sum(y) AS y FROM x GROUP BY 1),
e AS (SELECT sum(n) AS n, sum(CAST(abs(CAST(p AS DOUBLE) - CAST(y AS DOUBLE)) AS DECIMAL(20,8))) AS gaps FROM b), q AS (SELECT sum(CAST((p - y) * (p - y) AS DECIMAL(30,12))) AS squares FROM x)
SELECT CAST(n AS BIGINT) AS n, CAST(squares AS DOUBLE) / CAST(n AS DOUBLE) AS brier, CAST(gaps AS DOUBLE) / CAST(n AS DOUBLE) AS ece FROM e, q""")
def calibration_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fields(spark, sf_dir).withColumn("right", (_right() & F.col("predicted").isNotNull()).cast("int"))
    return metrics.calibration_error(rows, "confidence", "right")


@query(f"""WITH {_FIELD_SQL}, g AS (SELECT engine, count(*) AS n, count(*) FILTER (WHERE truth = predicted) AS s FROM f GROUP BY 1), q AS (SELECT engine, n, s, CAST(s AS DOUBLE) / n AS p FROM g)
SELECT engine, n, s AS successes, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS lower, round((p + 1.959963984540054 * 1.959963984540054 / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n))) / (1 + 1.959963984540054 * 1.959963984540054 / n), 9) AS upper FROM q""")
def wilson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score intervals of each engine's accuracy."""
    g = _fields(spark, sf_dir).groupBy("engine").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("successes"))
    return g.select("engine", "n", "successes", F.round(numbers.wilson(F.col("successes"), F.col("n"), False), 9).alias("lower"), F.round(numbers.wilson(F.col("successes"), F.col("n"), True), 9).alias("upper"))


@query("""SELECT event_id, round(1 / (1 + exp(-(value * 0.08 + -1.5))), 9) AS platt, round(1 / (1 + exp(-(ln(least(greatest(value / 100, 1e-6), 1 - 1e-6) / (1 - least(greatest(value / 100, 1e-6), 1 - 1e-6))) * 0.8 + 0.1))), 9) AS affine FROM events""")
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scores through a Platt and a logit-affine calibration."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(numbers.platt(v, 0.08, -1.5), 9).alias("platt"), F.round(numbers.logit_affine(v / 100, 0.8, 0.1), 9).alias("affine"))


#: Pooling in SQL: a score's rate is the largest, over begins at or before it, of the smallest mean up to an end at or after it.
_ISOTONIC = """ps AS (SELECT *, sum(positives) OVER w AS sy, sum(n) OVER w AS sn, row_number() OVER w AS k FROM {points} WINDOW w AS (PARTITION BY family ORDER BY score)),
mean AS (SELECT a.family, a.k AS j, b.k AS e, (b.sy - a.sy + a.positives) / (b.sn - a.sn + a.n) AS m FROM ps a JOIN ps b ON a.family = b.family AND b.k >= a.k),
low AS (SELECT family, j, e AS i, min(m) OVER (PARTITION BY family, j ORDER BY e DESC ROWS UNBOUNDED PRECEDING) AS m FROM mean), fit AS (SELECT family, i, max(m) AS p FROM low GROUP BY 1, 2)"""


@query(f"""WITH pts AS (SELECT '' AS family, CAST(n_chars AS DOUBLE) AS score, CAST(sum(quality) AS DOUBLE) AS positives, CAST(count(*) AS DOUBLE) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 2), {_ISOTONIC.format(points="pts")}
SELECT round(p, 9) AS value, min(score) AS lo, max(score) AS hi, CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS n FROM fit JOIN ps ON fit.i = ps.k GROUP BY 1""")
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-decreasing fit of quality to a document's length, over exact scores: its levels, and from where to where each holds."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("family", F.lit(""))
    blocks = calibration.isotonic_blocks(calibration.equal_scores(rows, ["family"], "n_chars", "quality"), ["family"])
    # blocks of equal rate are one level
    return blocks.groupBy(F.round(F.col("positives") / F.col("n"), 9).alias("value")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("positives").cast("long").alias("positives"), F.sum("n").cast("long").alias("n"))


def _newton(points: str, steps: int) -> str:
    """Common table expressions of Newton steps for a logistic curve of each family; the last one is ``step<steps>``."""
    out = [f"step0 AS (SELECT family, 1.0::DOUBLE AS a, ln(greatest(1e-6, least(1 - 1e-6, sum(positives) / sum(n))) / (1 - greatest(1e-6, least(1 - 1e-6, sum(positives) / sum(n))))) - sum(score * n) / sum(n) AS b FROM {points} GROUP BY 1)"]
    for k in range(steps):
        out.append(f"""g{k} AS (SELECT family, a, b, sum((n * p - positives) * score) / sum(n) + {calibration.RIDGE} * a AS gs, sum(n * p - positives) / sum(n) AS gi, sum(n * p * (1 - p) * score * score) / sum(n) + {calibration.RIDGE} AS hss, sum(n * p * (1 - p) * score) / sum(n) AS hsi, sum(n * p * (1 - p)) / sum(n) + 1e-12 AS hii
 FROM (SELECT *, 1 / (1 + exp(-(a * score + b))) AS p FROM {points} JOIN step{k} USING (family)) GROUP BY 1, 2, 3),
step{k + 1} AS (SELECT family, a - (hii * gs - hsi * gi) / (hss * hii - hsi * hsi) AS a, b - (hss * gi - hsi * gs) / (hss * hii - hsi * hsi) AS b FROM g{k})""")
    return ",\n".join(out)


def _quality(name: str) -> str:
    return f"""(SELECT family, sum(squares) / sum(m) AS brier, sum(abs(y - p)) / sum(m) AS ece FROM (SELECT family, {" + ".join(f"CAST(p >= {k / 10} AS INTEGER)" for k in range(1, 10))} AS bin, sum(n) AS m, sum(positives) AS y, sum(n * p) AS p, sum(positives * (1 - p) ** 2 + (n - positives) * p ** 2) AS squares FROM {name} GROUP BY 1, 2) GROUP BY 1)"""


_CALIBRATED = "SELECT event_type AS family, floor(least(value, 50) * 2) / 100 AS score, CAST(user_id % 10 + 1 <= least(value, 50) / 5 + event_id % 3 AS INTEGER) AS y, CASE event_id % 4 WHEN 0 THEN 'validation' WHEN 1 THEN 'holdout' ELSE 'calibration' END AS split FROM events"


@query(f"""WITH r AS ({_CALIBRATED}), grp AS (SELECT family, split, score, CAST(sum(y) AS DOUBLE) AS positives, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1, 2, 3),
tr AS MATERIALIZED (SELECT * FROM grp WHERE split = 'calibration'), va AS MATERIALIZED (SELECT * FROM grp WHERE split = 'validation'), {_newton("tr", 14)},
{_ISOTONIC.format(points="tr")}, knot AS (SELECT ps.family, score AS x, p FROM fit JOIN ps ON fit.family = ps.family AND fit.i = ps.k),
bp AS (SELECT va.*, 1 / (1 + exp(-(a * score + b))) AS p FROM va JOIN step14 USING (family)),
near AS (SELECT va.*, (SELECT max(x) FROM knot WHERE knot.family = va.family AND x <= score) AS x0, (SELECT min(x) FROM knot WHERE knot.family = va.family AND x >= score) AS x1 FROM va),
bi AS (SELECT near.family, score, positives, n, CASE WHEN x0 IS NULL THEN k1.p WHEN x1 IS NULL OR x0 = x1 THEN k0.p ELSE k0.p + (score - x0) * (k1.p - k0.p) / (x1 - x0) END AS p FROM near LEFT JOIN knot k0 ON k0.family = near.family AND k0.x = x0 LEFT JOIN knot k1 ON k1.family = near.family AND k1.x = x1),
ra AS (SELECT *, score AS p FROM va)
SELECT c.family, 'SELECTED' AS status, train, validation, CASE WHEN (i.brier, i.ece) < (q.brier, q.ece) THEN 'isotonic' ELSE 'platt' END AS selected, round(w.brier, 6) AS raw_brier, round(w.ece, 6) AS raw_ece, round(q.brier, 6) AS platt_brier, round(q.ece, 6) AS platt_ece, round(i.brier, 6) AS isotonic_brier, round(i.ece, 6) AS isotonic_ece
FROM (SELECT family, count(*) FILTER (WHERE split = 'calibration') AS train, count(*) FILTER (WHERE split = 'validation') AS validation FROM r GROUP BY 1) c JOIN {_quality("ra")} w USING (family) JOIN {_quality("bp")} q USING (family) JOIN {_quality("bi")} i USING (family)""")
def calibrator_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type of event the calibration curve that does best on its validation rows; the holdout isn't read."""
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS family", "floor(least(value, 50) * 2) / 100 AS score", "CAST(user_id % 10 + 1 <= least(value, 50) / 5 + event_id % 3 AS int) AS y", "CASE event_id % 4 WHEN 0 THEN 'validation' WHEN 1 THEN 'holdout' ELSE 'calibration' END AS split")
    report = calibration.chosen_calibrators(rows, "family", "score", "y", "split").report
    return report.select("family", "status", "train", "validation", "selected", *(F.round(f"{n}_{m}", 6).alias(f"{n}_{m}") for n in ("raw", "platt", "isotonic") for m in ("brier", "ece")))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(value) FILTER (WHERE k = greatest(ceil(0.95 * n), 1)) AS nearest_rank, max(value) FILTER (WHERE k = least(floor(n * 0.95), n - 1) + 1) AS floor_index, max(value) FILTER (WHERE k = CAST(floor(n * 0.95 + 0.999999) AS BIGINT)) AS epsilon_ceiling, max(value) FILTER (WHERE k = floor(0.95 * (n - 1)) + 1) AS scaled_index FROM r GROUP BY 1""")
def percentiles_four_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile by each of the four definitions in use."""
    w = Window.partitionBy("event_type")
    r = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w.orderBy("value"))).withColumn("n", F.count(F.lit(1)).over(w))
    n = F.col("n")
    places = {
        "nearest_rank": F.greatest(F.ceil(F.lit(0.95) * n), F.lit(1)), "floor_index": F.least(F.floor(n * F.lit(0.95)), n - 1) + 1,
        "epsilon_ceiling": F.floor(n * F.lit(0.95) + F.lit(0.999999)), "scaled_index": F.floor(F.lit(0.95) * (n - 1)) + 1,
    }
    return r.groupBy("event_type").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("k") == at, F.col("value"))).alias(name) for name, at in places.items()))


@query("""WITH g AS (SELECT source, count(*) FILTER (WHERE lang <> 'en') AS n0, count(*) FILTER (WHERE lang = 'en') AS n1, avg(n_chars) FILTER (WHERE lang <> 'en') AS m0, avg(n_chars) FILTER (WHERE lang = 'en') AS m1, var_samp(n_chars) FILTER (WHERE lang <> 'en') AS v0, var_samp(n_chars) FILTER (WHERE lang = 'en') AS v1 FROM documents GROUP BY 1)
SELECT source, n0, n1, round(CASE WHEN n0 > 1 AND n1 > 1 THEN (m1 - m0) / nullif(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 0) END, 6) AS effect FROM g""")
def effect_size_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much longer English documents of a source are, in pooled deviations."""
    out = metrics.effect_size(table(spark, sf_dir, "documents"), "n_chars", (F.col("lang") == "en").cast("int"), ["source"])
    return out.withColumn("effect", F.round("effect", 6))


@query("""WITH t AS (SELECT source, count(*) AS n, avg(n_chars) AS mean, median(n_chars) AS med, quantile_disc(n_chars, 0.1) AS p10, quantile_disc(n_chars, 0.9) AS p90, CAST(count(*) FILTER (WHERE n_chars < 200) AS DOUBLE) / count(*) AS short FROM documents GROUP BY 1) SELECT source, n, round(mean, 6) AS mean, med AS median, CAST(p10 AS DOUBLE) AS p10, CAST(p90 AS DOUBLE) AS p90, short FROM t""")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source")
    return g.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.median("n_chars").alias("median"), F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY n_chars)").alias("p10"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n_chars)").alias("p90"), numbers.rate(F.count_if(F.col("n_chars") < 200), F.count(F.lit(1))).alias("short"),
    )


@query("""SELECT b.item_id, d.doc_id, round(CAST(levenshtein(b.t, d.t) AS DOUBLE) / length(b.t), 9) AS cer
FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark) b JOIN (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents) d ON d.doc_id % 40 = b.item_id % 40 WHERE length(b.t) > 0""")
def cer_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of documents against the items they are paired with."""
    plain = F.regexp_replace("text", "[^ -~]", "")
    b = table(spark, sf_dir, "benchmark").select("item_id", plain.alias("expected"), (F.col("item_id") % 40).alias("k")).filter(F.length("expected") > 0)
    d = table(spark, sf_dir, "documents").select("doc_id", plain.alias("actual"), (F.col("doc_id") % 40).alias("k")).repartition("doc_id")  # however few tasks read them
    return d.join(b, "k").select("item_id", "doc_id", F.round(text.character_error_rate(F.col("expected"), F.col("actual"), edit_distance), 9).alias("cer"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS truth_among, count(*) AS n, arg_max(l_returnflag, {'p': 1 - l_discount, 's': -l_suppkey, 'q': l_quantity, 'e': l_extendedprice}) AS chosen FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN chosen = 'R' THEN 'CHOSEN' WHEN truth_among = 1 THEN 'AMONG_CANDIDATES' ELSE 'NOT_FOUND' END AS outcome, count(*) AS n, CAST(sum(n) AS BIGINT) AS candidates FROM c GROUP BY 1""")
def oracle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the truth was chosen, was there to be chosen, or was never read."""
    order = F.struct((1 - F.col("l_discount")).alias("p"), (-F.col("l_suppkey")).alias("s"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"))
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "R").alias("among"), F.count(F.lit(1)).alias("n"), F.max_by("l_returnflag", order).alias("chosen"))
    outcome = F.when(F.col("chosen") == "R", "CHOSEN").when(F.col("among"), "AMONG_CANDIDATES").otherwise("NOT_FOUND")
    return c.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("candidates"))


@query(f"""WITH {_FIELD_SQL}, o AS (SELECT CASE WHEN predicted IS NULL THEN 'ABSTAINED' WHEN confidence >= 0.95 AND truth = predicted THEN 'ACCEPTED_RIGHT' WHEN confidence >= 0.95 THEN 'FALSE_ACCEPT' WHEN truth = predicted THEN 'REVIEW_RIGHT' ELSE 'REVIEW_WRONG' END AS outcome FROM f)
SELECT outcome, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM o GROUP BY 1""")
def production_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's way through acceptance and review."""
    ok = F.col("truth") == F.col("predicted")
    outcome = F.when(F.col("predicted").isNull(), "ABSTAINED").when((F.col("confidence") >= 0.95) & ok, "ACCEPTED_RIGHT").when(F.col("confidence") >= 0.95, "FALSE_ACCEPT").when(ok, "REVIEW_RIGHT").otherwise("REVIEW_WRONG")
    counts = _fields(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()))


@query(f"""WITH {_FIELD_SQL} SELECT count(*) FILTER (WHERE confidence < 0.95) AS reviewed_before, count(*) FILTER (WHERE confidence < 0.95 AND confidence >= 0.9) AS accepted_after, count(*) FILTER (WHERE confidence < 0.95 AND confidence >= 0.9 AND truth = predicted) AS accepted_right, count(*) FILTER (WHERE confidence < 0.95 AND confidence >= 0.9 AND truth IS DISTINCT FROM predicted) AS false_accepts FROM f""")
def review_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lower threshold would take out of review, right and wrong."""
    gained = (F.col("confidence") < 0.95) & (F.col("confidence") >= 0.9)
    right = F.col("truth").eqNullSafe(F.col("predicted"))
    return _fields(spark, sf_dir).agg(
        F.count_if(F.col("confidence") < 0.95).alias("reviewed_before"), F.count_if(gained).alias("accepted_after"), F.count_if(gained & right).alias("accepted_right"), F.count_if(gained & ~right).alias("false_accepts")
    )


@query(f"""WITH {_FIELD_SQL}, r AS (SELECT document, field, unnest(list_filter([CASE WHEN predicted IS NULL THEN 'MISSING' END, CASE WHEN confidence < 0.95 THEN 'LOW_CONFIDENCE' END, CASE WHEN quality = 'low' THEN 'POOR_QUALITY' END], lambda x: x IS NOT NULL)) AS reason FROM f)
SELECT reason, count(*) AS n, count(DISTINCT document) AS documents FROM r GROUP BY 1""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons for review, a field may have several."""
    reasons = F.array_compact(F.array(F.when(F.col("predicted").isNull(), "MISSING"), F.when(F.col("confidence") < 0.95, "LOW_CONFIDENCE"), F.when(F.col("quality") == "low", "POOR_QUALITY")))
    return _fields(spark, sf_dir).select("document", F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document").alias("documents"))


@query("""WITH f AS (SELECT l_orderkey AS claim_id, list_distinct(list(l_returnflag)) AS have FROM lineitem GROUP BY 1), x AS (SELECT claim_id, have, unnest(['A', 'N', 'R']) AS added FROM f)
SELECT added, count(*) FILTER (WHERE len(have) < 3) AS blocked, count(*) FILTER (WHERE len(have) < 3 AND len(list_distinct(list_append(have, added))) = 3) AS resolved FROM x GROUP BY 1""")
def counterfactual_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that one more class of evidence would complete."""
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"))
    x = f.select("have", F.explode(F.array(*map(F.lit, "ANR"))).alias("added"))
    blocked = F.size("have") < 3
    return x.groupBy("added").agg(F.count_if(blocked).alias("blocked"), F.count_if(blocked & (F.size(F.array_union("have", F.array("added"))) == 3)).alias("resolved"))


@query("""WITH b AS (SELECT l_orderkey % 1000 AS x0, l_linenumber * 10.0 AS y0, l_orderkey % 1000 + l_quantity AS x1, l_linenumber * 10.0 + 8 AS y1, l_orderkey % 1000 + l_discount * 100 AS px0, l_linenumber * 10.0 + l_tax * 20 AS py0, l_orderkey % 1000 + l_quantity + l_discount * 50 AS px1, l_linenumber * 10.0 + 8 AS py1, l_linestatus AS form FROM lineitem),
i AS (SELECT form, greatest(least(x1, px1) - greatest(x0, px0), 0.0) * greatest(least(y1, py1) - greatest(y0, py0), 0.0) AS common, greatest(x1 - x0, 0.0) * greatest(y1 - y0, 0.0) AS a, greatest(px1 - px0, 0.0) * greatest(py1 - py0, 0.0) AS p FROM b),
r AS (SELECT form, CASE WHEN a + p - common > 0 THEN common / (a + p - common) ELSE 0.0 END AS iou, CASE WHEN a > 0 THEN common / a ELSE 0.0 END AS held FROM i)
SELECT form, count(*) AS n, CAST(sum(CAST(iou AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS mean_iou, CAST(count(*) FILTER (WHERE held >= 0.95) AS DOUBLE) / count(*) AS contained, CAST(count(*) FILTER (WHERE iou < 0.5) AS DOUBLE) / count(*) AS missed FROM r GROUP BY 1""")
def localization_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted boxes against the true ones: overlap and containment."""
    x0, y0 = (F.col("l_orderkey") % 1000).cast("double"), F.col("l_linenumber") * 10.0
    true = [x0, y0, x0 + F.col("l_quantity"), y0 + 8]
    found = [x0 + F.col("l_discount") * 100, y0 + F.col("l_tax") * 20, x0 + F.col("l_quantity") + F.col("l_discount") * 50, y0 + 8]
    r = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("form"), numbers.intersection_over_union(true, found).alias("iou"), numbers.containment(found, true).alias("held"))
    n = F.count(F.lit(1))
    return r.groupBy("form").agg(n.alias("n"), (F.sum(F.col("iou").cast("decimal(18,9)")).cast("double") / n).alias("mean_iou"), numbers.rate(F.count_if(F.col("held") >= 0.95), n).alias("contained"), numbers.rate(F.count_if(F.col("iou") < 0.5), n).alias("missed"))


@query("""WITH r AS (SELECT event_type AS route, count(*) AS n, sum(CAST(value AS DECIMAL(18,4))) AS units FROM events GROUP BY 1), s AS (SELECT * FROM (VALUES ('base', 0.05, 0.10), ('busy', 0.05, 0.30), ('lean', 0.02, 0.10)) t(scenario, per_unit, review))
SELECT scenario, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(units) AS DOUBLE) * per_unit + CAST(sum(n) AS DOUBLE) * review * 1.5, 6) AS cost FROM r, s GROUP BY scenario, per_unit, review""")
def cost_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine and review cost of one route mix under several prices."""
    mix = table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("units"))
    prices = spark.createDataFrame([("base", 0.05, 0.10), ("busy", 0.05, 0.30), ("lean", 0.02, 0.10)], "scenario string, per_unit double, review double")
    return prices.crossJoin(F.broadcast(mix)).select("scenario", "n", F.round(F.col("units").cast("double") * F.col("per_unit") + F.col("n").cast("double") * F.col("review") * 1.5, 6).alias("cost"))


@query("""WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), d AS (SELECT source, lang, n_chars > 2000 AS long FROM documents)
SELECT s.source AS held_out, count(*) AS n_train, CAST(count(*) FILTER (WHERE d.long) AS DOUBLE) / count(*) AS train_rate, (SELECT CAST(count(*) FILTER (WHERE x.long) AS DOUBLE) / count(*) FROM d x WHERE x.source = s.source) AS held_rate FROM s JOIN d ON d.source <> s.source GROUP BY s.source""")
def leave_one_source_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with each source held out: totals less the source's own, so rows aren't joined once per source."""
    g = table(spark, sf_dir, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("k"))
    total = g.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    rest, hits = F.col("all_n") - F.col("n"), F.col("all_k") - F.col("k")
    return g.crossJoin(F.broadcast(total)).select(F.col("source").alias("held_out"), rest.alias("n_train"), numbers.rate(hits, rest).alias("train_rate"), numbers.rate(F.col("k"), F.col("n")).alias("held_rate"))
