"""Pages and candidates: value voting, page selection, region conflicts, service lines, sequence repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import decisions as d
from ..operators import ranking
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""WITH g AS (SELECT l_orderkey AS field, l_returnflag AS v, count(*) AS support, count(DISTINCT l_suppkey % 3) AS families, max(1 - l_discount) AS best, bool_or(l_tax = 0) AS pixel FROM lineitem GROUP BY 1, 2),
s AS (SELECT field, v, round(least(1.0, least(0.6, 0.2 * families) + 0.15 * least(support, 2) / 2 + 0.2 * best + CASE WHEN pixel THEN 0.2 ELSE 0.0 END), 9) AS score FROM g),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS s2 FROM s WINDOW w AS (PARTITION BY field ORDER BY score DESC, v))
SELECT field, v AS value, score, CASE WHEN score < 0.45 THEN 'TOO_WEAK' WHEN round(score - coalesce(s2, 0), 9) < 0.08 THEN 'AMBIGUOUS_VALUE' ELSE 'SELECTED' END AS status FROM r WHERE k = 1""")
def value_group_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with one value score together: families, support, confidence, pixels; then a margin."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("field"), F.col("l_returnflag").alias("value")).agg(
        F.count(F.lit(1)).alias("support"), F.countDistinct(F.col("l_suppkey") % 3).alias("families"), F.max(1 - F.col("l_discount")).alias("best"), F.bool_or(F.col("l_tax") == 0).alias("pixel")
    )
    score = F.least(F.lit(0.6), 0.2 * F.col("families")) + 0.15 * F.least("support", F.lit(2)) / 2 + 0.2 * F.col("best") + F.when(F.col("pixel"), 0.2).otherwise(0.0)
    best = ranking.top_with_margin(g.withColumn("score", F.round(F.least(F.lit(1.0), score), 9)), ["field"], "score", [F.col("value")])
    return best.select("field", "value", "score", d.ladder((F.col("score") < 0.45, "TOO_WEAK"), (F.round("margin", 9) < 0.08, "AMBIGUOUS_VALUE"), otherwise="SELECTED").alias("status"))


@query("""WITH p AS (SELECT user_id AS bundle, event_id AS page, round(value / 60, 9) AS confidence FROM events), r AS (SELECT *, row_number() OVER w AS k, first_value(confidence) OVER w AS top, nth_value(confidence, 2) OVER (PARTITION BY bundle ORDER BY confidence DESC, page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM p WINDOW w AS (PARTITION BY bundle ORDER BY confidence DESC, page))
SELECT bundle, page, CASE WHEN k = 1 AND top >= 0.5 AND round(top - coalesce(second, 0), 9) >= 0.08 THEN 'SELECTED' WHEN top >= 0.5 AND round(top - coalesce(second, 0), 9) >= 0.08 THEN 'ATTACHMENT' ELSE 'UNKNOWN' END AS role FROM r""")
def bundle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one page of a bundle that stands out, with the others its attachments; else none is known."""
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("bundle"), F.col("event_id").alias("page"), F.round(F.col("value") / 60, 9).alias("confidence"))
    best = ranking.top_with_margin(p, ["bundle"], "confidence", [F.col("page")]).select("bundle", F.col("page").alias("first"), ((F.col("confidence") >= 0.5) & (F.round("margin", 9) >= 0.08)).alias("unique"))
    return p.join(best, "bundle").select("bundle", "page", F.when(F.col("unique"), F.when(F.col("page") == F.col("first"), "SELECTED").otherwise("ATTACHMENT")).otherwise("UNKNOWN").alias("role"))


@query("""WITH a AS (SELECT source AS document, md5(text) AS crop, min(doc_id) AS id FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY id) AS k FROM a) SELECT document, id FROM r WHERE k <= 3""")
def sealed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three different predictions are sealed for each document, the first ones: the cap is the policy."""
    a = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("document"), F.md5("text").alias("crop")).agg(F.min("doc_id").alias("id"))
    k = F.row_number().over(Window.partitionBy("document").orderBy("id"))
    return a.withColumn("k", k).filter("k <= 3").select("document", "id")


@query("""WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS ws FROM conversations), g AS (SELECT conv_id, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS gram FROM w WHERE len(ws) > 1) SELECT conv_id, gram, count(*) AS n FROM g GROUP BY 1, 2""")
def phrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring words of each page."""
    ws = F.split(F.lower("text"), " ")
    grams = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1)))
    return table(spark, sf_dir, "conversations").select("conv_id", F.explode(grams).alias("gram")).groupBy("conv_id", "gram").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS claim, l_linenumber AS row, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS charge, bool_or(l_quantity < 2) AS blank FROM lineitem GROUP BY 1, 2), s AS (SELECT *, sum(CAST(blank AS INTEGER)) OVER (PARTITION BY claim ORDER BY row) AS blanks FROM l)
SELECT claim, count(*) AS rows, CAST(sum(charge) AS DOUBLE) AS total FROM s WHERE blanks = 0 GROUP BY 1""")
def rows_until_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service lines up to the first blank row."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("row")).agg(F.sum(numbers.cents(F.col("l_extendedprice"))).alias("charge"), F.bool_or(F.col("l_quantity") < 2).alias("blank"))
    blanks = F.sum(F.col("blank").cast("int")).over(Window.partitionBy("claim").orderBy("row"))
    return lines.withColumn("blanks", blanks).filter("blanks = 0").groupBy("claim").agg(F.count(F.lit(1)).alias("rows"), F.sum("charge").cast("double").alias("total"))


@query("""WITH c AS (SELECT event_id, value / 60 AS score, user_id % 5 = 0 AS neighbour, user_id % 7 = 0 AS own_label, user_id % 3 = 0 AS second, (event_id % 100) / 2000.0 AS margin FROM events)
SELECT CASE WHEN neighbour THEN 'WRONG_NEIGHBOUR' WHEN own_label THEN 'LABEL_CONTAMINATED' WHEN second THEN 'MULTI_FIELD' WHEN margin < 0.025 THEN 'AMBIGUOUS' ELSE 'OWNED' END AS ownership, count(*) AS n FROM c GROUP BY 1""")
def region_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a region may not belong to its field."""
    u = F.col("user_id")
    state = d.ladder((u % 5 == 0, "WRONG_NEIGHBOUR"), (u % 7 == 0, "LABEL_CONTAMINATED"), (u % 3 == 0, "MULTI_FIELD"), (F.col("event_id") % 100 < 50, "AMBIGUOUS"), otherwise="OWNED")
    return table(spark, sf_dir, "events").groupBy(state.alias("ownership")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT conv_id AS zone, min(turn * 10.0) AS x0, max(turn * 10.0 + length(text)) AS x1, max(turn * 12.0) - min(turn * 12.0) AS spread, avg(1.0 / (1 + turn)) AS confidence, count(*) AS n FROM conversations WHERE length(text) > 20 GROUP BY 1)
SELECT zone, CASE WHEN spread > 24 THEN 'UNCERTAIN' ELSE 'REPAIRED' END AS state, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, round(CAST(confidence AS DOUBLE), 9) AS confidence FROM t""")
def location_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union box of a zone's tokens, unless they spread too far."""
    x = F.col("turn") * 10.0
    t = table(spark, sf_dir, "conversations").filter(F.length("text") > 20).groupBy(F.col("conv_id").alias("zone")).agg(
        F.min(x).alias("x0"), F.max(x + F.length("text")).alias("x1"), ((F.max("turn") - F.min("turn")) * 12).alias("spread"), F.avg(1.0 / (1 + F.col("turn"))).alias("confidence")
    )
    return t.select("zone", F.when(F.col("spread") > 24, "UNCERTAIN").otherwise("REPAIRED").alias("state"), "x0", "x1", F.round("confidence", 9).alias("confidence"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'CACHE' WHEN o_custkey % 3 = 0 THEN 'REFERENCE' WHEN o_totalprice < 100000 THEN 'LOCAL' WHEN o_custkey % 5 = 0 THEN 'CLOUD' ELSE 'HUMAN' END AS route FROM orders""")
def fallback_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a field goes when its first reading isn't good enough."""
    route = d.ladder((F.col("o_orderstatus") == "F", "CACHE"), (F.col("o_custkey") % 3 == 0, "REFERENCE"), (F.col("o_totalprice") < 100000, "LOCAL"), (F.col("o_custkey") % 5 == 0, "CLOUD"), otherwise="HUMAN")
    return table(spark, sf_dir, "orders").select("o_orderkey", route.alias("route"))


@query("""WITH RECURSIVE q AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), s AS (SELECT user_id, event_id, k, CASE WHEN value > 12 THEN 1 ELSE 0 END AS failures FROM q WHERE k = 1 UNION ALL SELECT q.user_id, q.event_id, q.k, CASE WHEN value > 12 THEN s.failures + 1 ELSE 0 END FROM s JOIN q ON q.user_id = s.user_id AND q.k = s.k + 1)
SELECT user_id, count(*) FILTER (WHERE failures >= 3) AS open_events, CAST(max(failures) AS BIGINT) AS longest FROM s GROUP BY 1""")
def breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row: how often a circuit breaker that opens at three would have been open."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    q = table(spark, sf_dir, "events").withColumn("bad", (F.col("value") > 12).cast("int")).withColumn("run", F.sum(1 - F.col("bad")).over(w))
    row = F.sum("bad").over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return q.withColumn("failures", row).groupBy("user_id").agg(F.count_if(F.col("failures") >= 3).alias("open_events"), F.max("failures").alias("longest"))
