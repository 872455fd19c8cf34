"""Routes of pages and fields over stand-in columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

#: Text of both dialects.
_PAGE = """doc_id, source, lang, CASE doc_id % 6 WHEN 0 THEN 'CMS1500' WHEN 1 THEN 'UB04' WHEN 2 THEN 'CUSTOM_A' WHEN 3 THEN 'CLAIM_SUPPORT' WHEN 4 THEN 'NON_CLAIM' ELSE 'UNKNOWN_X' END AS t, CASE WHEN n_chars % 3 = 0 THEN 'UB04' WHEN doc_id % 6 = 0 THEN 'CMS1500' WHEN doc_id % 6 = 4 THEN 'NON_CLAIM' ELSE 'UNKNOWN_STRUCTURED' END AS p,
 CASE WHEN doc_id % 6 = 4 THEN 'NON_CLAIM' ELSE 'CLAIM' END AS top, CASE n_chars % 5 WHEN 0 THEN 'CMS_STANDARD_EXTRACTOR' WHEN 1 THEN 'UB_STANDARD_EXTRACTOR' WHEN 2 THEN 'LAYOUT_STRUCTURED_EXTRACTOR' WHEN 3 THEN 'UNSTRUCTURED_EXTRACTOR' ELSE 'SAFE_UNKNOWN' END AS r,
 CASE doc_id % 6 WHEN 0 THEN 'CMS_STANDARD_EXTRACTOR' WHEN 1 THEN 'UB_STANDARD_EXTRACTOR' ELSE 'LAYOUT_STRUCTURED_EXTRACTOR' END AS er, doc_id % 4 AS calls, doc_id % 2 AS cloud, n_chars % 1000 AS ms"""


def _part(of: str, among: str = "TRUE") -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {among}) = 0 THEN 0.0::DOUBLE ELSE CAST(count(*) FILTER (WHERE ({of}) AND ({among})) AS DOUBLE) / count(*) FILTER (WHERE {among}) END"


_STANDARD, _FIXED = "t IN ('CMS1500', 'UB04')", "r IN ('CMS_STANDARD_EXTRACTOR', 'UB_STANDARD_EXTRACTOR')"


@query(f"""WITH d AS (SELECT {_PAGE} FROM documents)
SELECT source, lang, CAST(GROUPING(source, lang) AS BIGINT) AS grouping, count(*) AS documents, {_part("t = p")} AS family_accuracy, {_part("CASE WHEN t = 'UNKNOWN_X' THEN 'UNKNOWN' WHEN t IN ('CLAIM_SUPPORT', 'NON_CLAIM') THEN t ELSE 'CLAIM' END = top")} AS top_level_accuracy, {_part("r = er")} AS route_accuracy, {_part(_STANDARD, "p IN ('CMS1500', 'UB04')")} AS nomination_precision, {_part("t = p", _STANDARD)} AS nomination_recall,
 {_part("t = 'CMS1500'", "p = 'CMS1500'")} AS "CMS1500_precision", {_part("p = 'CMS1500'", "t = 'CMS1500'")} AS "CMS1500_recall", {_part("t = 'UB04'", "p = 'UB04'")} AS "UB04_precision", {_part("p = 'UB04'", "t = 'UB04'")} AS "UB04_recall", {_part("p IN ('UNKNOWN_STRUCTURED', 'CMS1500', 'UB04')", "t = 'CUSTOM_A'")} AS custom_recognition,
 {_part("r IN ('LAYOUT_STRUCTURED_EXTRACTOR', 'UNSTRUCTURED_EXTRACTOR')", "t = 'CLAIM_SUPPORT'")} AS support_compatibility, {_part("p = 'NON_CLAIM'", "t = 'NON_CLAIM'")} AS non_claim_recall, {_part(f"NOT {_FIXED}", "t = 'UNKNOWN_X'")} AS unknown_compatibility, count(*) FILTER (WHERE NOT {_STANDARD} AND {_FIXED}) AS false_standard, {_part(_FIXED, f"NOT {_STANDARD}")} AS false_standard_rate,
 {_part("r = 'UB_STANDARD_EXTRACTOR'", "t = 'CMS1500'")} AS "CMS1500_to_UB04", {_part("r = 'CMS_STANDARD_EXTRACTOR'", "t = 'UB04'")} AS "UB04_to_CMS1500", count(*) FILTER (WHERE {_STANDARD} AND t = p AND r = 'LAYOUT_STRUCTURED_EXTRACTOR') AS safe_fallbacks, {_part("t = p AND r = 'LAYOUT_STRUCTURED_EXTRACTOR'", _STANDARD)} AS safe_fallback_rate,
 CAST(sum(calls) AS DOUBLE) / count(*) AS calls_per_page, CAST(sum(cloud) AS BIGINT) AS cloud_calls, CAST(quantile_disc(ms, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(ms, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(ms, 0.99) AS DOUBLE) AS p99, avg(ms) AS mean_latency FROM d GROUP BY GROUPING SETS ((), (source), (lang))""")
def routing_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rates of a routing benchmark, over all pages, by source and by language."""
    pages = table(spark, sf_dir, "documents").selectExpr(*_columns(_PAGE))
    return routing.benchmark_rates(pages, "t", "p", "top", "er", "r", "calls", "cloud", "ms", [["source"], ["lang"]])


def _columns(text: str) -> list[str]:
    """The parts of a select list; none has a comma outside its CASE."""
    return [x.strip() for x in text.split(",")]


_OUTCOME = """source, CASE doc_id % 5 WHEN 0 THEN 'CMS1500' WHEN 1 THEN 'UB04' WHEN 2 THEN 'EOB' WHEN 3 THEN 'CLINICAL_NOTE' ELSE 'UNKNOWN' END AS t, CASE WHEN n_chars % 3 = 0 THEN 'CMS1500' WHEN doc_id % 5 = 2 THEN 'EOB' ELSE 'UNKNOWN' END AS p,
 CASE n_chars % 4 WHEN 0 THEN 'CMS_STANDARD_EXTRACTOR' WHEN 1 THEN 'UB_STANDARD_EXTRACTOR' WHEN 2 THEN 'LAYOUT_STRUCTURED_EXTRACTOR' ELSE 'SAFE_UNKNOWN' END AS r, doc_id % 7 = 0 AS a, CASE WHEN doc_id % 3 = 0 THEN 'VERIFIED' END AS s, CASE WHEN doc_id % 2 = 0 THEN 'CMS1500' ELSE 'UB04' END AS f, CASE WHEN doc_id % 11 = 0 THEN 'SAFE_UNKNOWN' END AS g"""
_FALLBACK = "t = p AND r IN ('LAYOUT_STRUCTURED_EXTRACTOR', 'SAFE_UNKNOWN') AND s IS NULL"


@query(f"""WITH o AS (SELECT {_OUTCOME} FROM documents), e AS (SELECT *, CASE t WHEN 'CMS1500' THEN 'CMS_STANDARD_EXTRACTOR' WHEN 'UB04' THEN 'UB_STANDARD_EXTRACTOR' WHEN 'EOB' THEN 'LAYOUT_STRUCTURED_EXTRACTOR' WHEN 'CLINICAL_NOTE' THEN 'UNSTRUCTURED_EXTRACTOR' ELSE 'SAFE_UNKNOWN' END AS own FROM o),
k AS (SELECT *, CASE WHEN {_FIXED} AND NOT {_STANDARD} THEN 100 WHEN {_FIXED} AND r <> own THEN 80 WHEN r <> coalesce(g, own) THEN 40 WHEN t <> p THEN 5 ELSE 0 END AS risk FROM e)
SELECT source, count(*) AS documents, {_part("t = p")} AS class_accuracy, {_part("r = coalesce(g, own)")} AS route_accuracy, {_part(_FIXED, f"NOT {_STANDARD}")} AS false_standard_rate, {_part("r = 'CMS_STANDARD_EXTRACTOR'", f"NOT {_STANDARD}")} AS "CMS1500_false_rate", {_part("r = 'UB_STANDARD_EXTRACTOR'", f"NOT {_STANDARD}")} AS "UB04_false_rate",
 {_part(f"{_FIXED} AND r <> own", _STANDARD)} AS misroute_rate, {_part("r = 'UB_STANDARD_EXTRACTOR'", "t = 'CMS1500'")} AS "CMS1500_to_UB04", {_part("r = 'CMS_STANDARD_EXTRACTOR'", "t = 'UB04'")} AS "UB04_to_CMS1500", {_part("r = 'CMS_STANDARD_EXTRACTOR' AND NOT (s IS NOT NULL AND f = 'CMS1500') OR r = 'UB_STANDARD_EXTRACTOR' AND NOT (s IS NOT NULL AND f = 'UB04')")} AS unverified_rate,
 {_part(_FALLBACK, _STANDARD)} AS safe_fallback_rate, {_part(_FALLBACK, "t = 'CMS1500'")} AS "CMS1500_safe_fallback_rate", {_part(_FALLBACK, "t = 'UB04'")} AS "UB04_safe_fallback_rate", {_part("a")} AS abstention_rate, {_part("t = p", "NOT a")} AS accuracy_not_abstained, avg(risk) AS mean_risk FROM k GROUP BY source""")
def routing_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What routing authorised, by source: rates and mean risk."""
    o = table(spark, sf_dir, "documents").selectExpr(*_columns(_OUTCOME))
    return routing.outcome_rates(o, *(F.col(c) for c in ("t", "p", "r", "a", "s", "f", "g")), by=("source",))


_ROUTE = "p_partkey AS position, 'r' || CAST(p_partkey AS {text}) AS route_id, 'f' || CAST(p_size % 7 AS {text}) AS field, CASE p_partkey % 9 WHEN 0 THEN '*' WHEN 1 THEN 'ub04' WHEN 2 THEN 'CMS1500' ELSE p_brand END AS form, CASE p_size % 4 WHEN 0 THEN 'SHADOW' WHEN 1 THEN 'DISABLED' WHEN 2 THEN 'PRODUCTION_APPROVED' ELSE 'EXPERIMENTAL' END AS status"


@query(f"""WITH r AS (SELECT {_ROUTE.format(text="VARCHAR")} FROM part WHERE p_size % 4 <> 1), q AS (SELECT l_orderkey AS document, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, 'f' || CAST(l_suppkey % 8 AS VARCHAR) AS field, CASE l_returnflag WHEN 'R' THEN 'UB04' WHEN 'A' THEN 'cms1500' ELSE 'OTHER' END AS family FROM lineitem),
f AS (SELECT k.field, k.family, arg_min(route_id, position) AS route_id FROM (SELECT DISTINCT field, family FROM q) k JOIN r ON r.field = k.field AND (r.form = '*' OR upper(r.form) = upper(k.family)) GROUP BY 1, 2)
SELECT document, line, part, supplier, q.field, q.family, route_id FROM q LEFT JOIN f ON f.field = q.field AND f.family = q.family""")
def registered_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first route of the registry that evaluation may use, for every field."""
    routes = table(spark, sf_dir, "part").selectExpr(*_columns(_ROUTE.format(text="STRING")))
    family = F.when(F.col("l_returnflag") == "R", "UB04").when(F.col("l_returnflag") == "A", "cms1500").otherwise("OTHER")
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.concat(F.lit("f"), (F.col("l_suppkey") % 8).cast("string")).alias("field"), family.alias("family"))
    return routing.registered_routes(asked, routes, "field", "family", "evaluation")


@query("""WITH k AS (SELECT 'm' || CAST(c_custkey - CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS member_id, CAST(1940 + c_nationkey AS VARCHAR) AS dob FROM customer), one AS (SELECT member_id, count(*) AS n, min(dob) AS ref FROM k GROUP BY 1),
q AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'm' || CAST(o_custkey AS VARCHAR) END AS member_id, CASE WHEN o_orderkey % 5 = 0 THEN '1940' ELSE CAST(1940 + c_nationkey AS VARCHAR) END AS dob, o_orderkey % 10 > 2 AS alike, o_orderstatus = 'P' AS against FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT request, CASE WHEN q.member_id <> '' AND n = 1 AND ref = dob AND alike AND NOT against THEN 'REFERENCE_VERIFIED' ELSE 'HUMAN_REVIEW_REQUIRED' END AS decision, CASE WHEN q.member_id = '' THEN '' WHEN n = 1 AND ref = dob THEN 'member_id,dob,name' ELSE 'member_id' END AS attributes,
 CASE WHEN q.member_id = '' THEN 'MISSING_ID_OR_DOB' WHEN coalesce(n, 0) <> 1 THEN 'REFERENCE_NOT_UNIQUE' WHEN against THEN 'ADDRESS_CONTRADICTION' ELSE '' END AS contradictions FROM q LEFT JOIN one ON one.member_id = q.member_id""")
def verified_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that a reference verifies, and what the others lack."""
    c, key = table(spark, sf_dir, "customer"), F.col("o_orderkey")
    born = (F.col("c_nationkey") + 1940).cast("string")
    known = c.select(F.concat(F.lit("m"), (F.col("c_custkey") - F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)).cast("string")).alias("member_id"), born.alias("dob"))
    o = table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    asked = o.select(key.alias("request"), F.when(key % 13 == 0, "").otherwise(F.concat(F.lit("m"), F.col("o_custkey").cast("string"))).alias("member_id"), F.when(key % 5 == 0, "1940").otherwise(born).alias("dob"), F.when(key % 10 > 2, 0.95).otherwise(0.9).alias("similarity"), (F.col("o_orderstatus") == "P").alias("contradicted"))
    return routing.verified_members(asked, known).select("request", "decision", F.array_join("attributes", ",").alias("attributes"), F.array_join("contradictions", ",").alias("contradictions"))
