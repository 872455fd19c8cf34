"""Whole decision rules over stand-in columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ladders
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""WITH l AS (SELECT doc_id, quality, toxic FROM labels)
SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 4 = doc_id % 3 THEN 'INDEPENDENT_APPROVER_REQUIRED' END, CASE WHEN doc_id % 5 = 0 THEN 'DETERMINISTIC_VALIDATION_REQUIRED' END, CASE WHEN quality = 0 THEN 'CLAIM_REVALIDATION_REQUIRED' END, CASE WHEN toxic = 1 THEN 'VISIBLE_CROP_EVIDENCE_REQUIRED' END, CASE WHEN doc_id % 19 = 0 THEN 'CROP_QUALITY_NOT_APPROVED' END,
 CASE WHEN doc_id % 13 = 0 THEN 'EMPTY_CORRECTION' END, CASE WHEN doc_id % 10 = 0 OR doc_id % 9 = 0 THEN 'HOLDOUT_FEEDBACK_EXCLUDED' END, CASE WHEN doc_id % 17 = 0 THEN 'AUTOMATIC_PRODUCTION_RETUNING_PROHIBITED' END) AS reasons FROM l""")
def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that speaks against learning from a corrected label."""
    k = F.col("doc_id")
    trust = ladders.label_trust(k % 4, k % 3, k % 5 != 0, F.col("quality") == 1, F.col("toxic") == 0, k % 19 != 0, F.when(k % 13 == 0, " ").otherwise("x"), k % 10 == 0, F.when(k % 9 == 0, "holdout").otherwise("train"), k % 17 == 0)
    return table(spark, sf_dir, "labels").select("doc_id", F.array_join(trust["reasons"], ",").alias("reasons"))


_TRAITS = {"PAGE_GEOMETRY": "<nav", "CLAIM_DIAGNOSIS_LAYOUT": "<h1>", "SERVICE_LINE_GRID": "<article>", "PROVIDER_BILLING_LAYOUT": "<footer", "SPATIAL_RELATIONSHIPS": "<p>"}
_N = " + ".join(f"CAST(contains(html, '{s}') AS INTEGER)" for s in _TRAITS.values())


@query(f"""WITH t AS (SELECT page_id, {_N} AS n, contains(html, '<article>') AND contains(html, '<p>') AS essential, contains(html, '<table') AS ub, page_id % 7 = 0 AS other FROM pages)
SELECT page_id, CASE WHEN n >= 3 AND essential AND NOT ub AND NOT other THEN 'VERIFIED' WHEN n >= 2 AND NOT ub AND NOT other THEN 'AMBIGUOUS' ELSE 'NOT_VERIFIED' END AS status, n / 8.0::DOUBLE AS score,
 CASE WHEN n >= 3 AND essential AND NOT ub AND NOT other THEN 'CMS_VERIFIED_IDENTITY' WHEN ub THEN 'CMS_UB_CONTRADICTION' WHEN other THEN 'CMS_LAYOUT_CONTRADICTION' WHEN n >= 2 THEN 'CMS_AMBIGUOUS' ELSE 'CMS_INSUFFICIENT_EVIDENCE' END AS reason FROM t""")
def form_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages are the form they are taken for, what speaks for it and what against."""
    scores = {name: F.contains("html", F.lit(s)).cast("double") for name, s in _TRAITS.items()}
    scores |= {name: F.lit(None).cast("double") for name in ladders.FORM_TRAITS if name not in scores}
    against = F.array_compact(F.array(F.when(F.contains("html", F.lit("<table")), "UB_GRID"), F.when(F.col("page_id") % 7 == 0, "MARGIN")))
    return table(spark, sf_dir, "pages").select("page_id", ladders.form_identity(scores, against).alias("f")).select("page_id", "f.status", "f.score", "f.reason")


_ROUTES = {
    "npi": [{"action": "RAPIDOCR", "cost": 0.1, "seconds": 1.0}, {"action": "REFERENCE_LOOKUP", "cost": 0.05, "seconds": 1.0, "reference": True}, {"action": "HITL", "cost": 1.0, "seconds": 300.0}],
    "default": [{"action": "RAPIDOCR", "cost": 0.1, "seconds": 1.0}, {"action": "GEMINI_CHEAP", "cost": 0.5, "seconds": 2.0, "cloud": True}, {"action": "HITL", "cost": 1.0, "seconds": 300.0}],
}


@query("""WITH r AS (SELECT l_orderkey AS document, l_linenumber AS line, l_partkey AS part, l_partkey % 2 = 0 AS npi, 1 - l_discount * 5 AS reg, l_suppkey % 5 <> 0 AS safe, l_quantity > 10 AS ev, 1 - l_tax AS conf, l_returnflag = 'R' AS crit, l_quantity / 50 AS image, l_suppkey % 2 = 0 AS read, l_suppkey % 3 = 0 AS cut, l_linestatus = 'F' AS prep, l_quantity / 40 AS budget, l_partkey % 3 = 0 AS cloud, l_partkey % 4 = 0 AS ref FROM lineitem),
s AS (SELECT *, CASE WHEN NOT npi THEN '' WHEN NOT ref THEN 'reference_unavailable' WHEN budget < 0.05 THEN 'budget_exceeded' ELSE '' END AS w2n, CASE WHEN NOT cloud THEN 'cloud_processing_disallowed' WHEN budget < 0.5 THEN 'budget_exceeded' ELSE '' END AS w2d, CASE WHEN budget < 1 THEN 'budget_exceeded' ELSE '' END AS w3, CASE WHEN budget < 0.1 THEN 'budget_exceeded' ELSE '' END AS w1 FROM r),
t AS (SELECT *, CASE WHEN npi THEN w2n ELSE w2d END AS w2, CASE WHEN reg < 0.6 THEN 'HITL|registration|registration_rejected' WHEN NOT safe AND NOT cut THEN 'EXPAND_CROP|crop_safety|wrong_crop_suspected' WHEN NOT safe THEN 'HITL|crop_safety|wrong_crop_suspected' WHEN reg < 0.8 AND NOT cut THEN 'EXPAND_CROP|registration|bounded_registration_uncertainty'
  WHEN ev AND conf >= CASE WHEN crit THEN 0.95 ELSE 0.90 END AND reg >= 0.8 THEN 'ACCEPT|accept|evidence_policy_satisfied' WHEN image < 0.6 AND read AND NOT prep THEN 'RETRY_PREPROCESSING|image_quality|low_image_quality' END AS early FROM s),
u AS (SELECT *, CASE WHEN NOT read AND w1 = '' THEN 'RAPIDOCR' WHEN w2 = '' THEN CASE WHEN npi THEN 'REFERENCE_LOOKUP' ELSE 'GEMINI_CHEAP' END WHEN w3 = '' THEN 'HITL' ELSE '' END AS step, CASE WHEN NOT read AND w1 = '' THEN [] WHEN w2 = '' THEN [CASE WHEN read THEN '' ELSE w1 END] WHEN w3 = '' THEN [CASE WHEN read THEN '' ELSE w1 END, w2] ELSE [CASE WHEN read THEN '' ELSE w1 END, w2, w3] END AS skipped FROM t)
SELECT document, line, part, CASE WHEN early IS NOT NULL THEN split_part(early, '|', 1) WHEN step = '' THEN 'HITL' ELSE step END AS action, CASE WHEN early IS NOT NULL THEN split_part(early, '|', 2) WHEN npi THEN 'npi' ELSE 'default' END AS stage,
 CASE WHEN early IS NOT NULL THEN split_part(early, '|', 3) ELSE array_to_string(list_concat([CASE WHEN step = '' THEN 'automated_routes_exhausted' ELSE 'needs_more_evidence' END], list_sort(list_distinct(list_filter(skipped, lambda x: x <> '')))), ',') END AS reasons, count(*) AS n FROM u GROUP BY ALL""")
def adaptive_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next step for every field, down the whole policy."""
    c = F.col
    field = F.when(c("l_partkey") % 2 == 0, "provider_npi").otherwise("remark")
    tried = F.array_compact(F.array(F.when(c("l_suppkey") % 2 == 0, "RAPIDOCR"), F.when(c("l_suppkey") % 3 == 0, "EXPAND_CROP"), F.when(c("l_linestatus") == "F", "RETRY_PREPROCESSING")))
    step = ladders.adaptive_action(
        ladders.field_route(field, F.lit(False)), _ROUTES, 1 - c("l_discount") * 5, c("l_suppkey") % 5 != 0, F.lit(True), c("l_quantity") > 10, F.lit(False), 1 - c("l_tax"), c("l_returnflag") == "R", c("l_quantity") / 50, tried, c("l_quantity") / 40, F.lit(600.0), c("l_partkey") % 3 == 0, c("l_partkey") % 4 == 0
    )
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("document"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), step.alias("s"))
    return rows.groupBy("document", "line", "part", "s.action", "s.stage", F.array_join("s.reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT l_orderkey % 97 AS grp, l_suppkey % 23 <> 0 AS configured, l_suppkey % 19 = 0 AS wrong, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 1 - l_discount * 5 END AS reg, l_partkey % 31 = 0 AS contra, l_quantity > 5 AS valid, l_quantity > 2 AS has, l_returnflag = 'R' AS crit, l_linenumber > 1 AS cal,
 CASE l_partkey % 5 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REFERENCE_CONFIRMED' WHEN 2 THEN 'ESCALATE' WHEN 3 THEN 'ABSTAIN' ELSE 'HITL' END AS dec, l_tax < 0.05 AS met, l_linestatus = 'F' AS blocks, l_suppkey % 2 = 0 AS rev, CASE l_suppkey % 3 WHEN 0 THEN 'HUMAN_REVIEW' WHEN 1 THEN 'REFERENCE_LOOKUP' END AS gap FROM lineitem),
d AS (SELECT *, CASE WHEN NOT configured THEN 'HUMAN_REVIEW_REQUIRED|HUMAN_REVIEW|FIELD_POLICY_NOT_CONFIGURED' WHEN wrong THEN 'ESCALATE|CROP_RECOVERY|WRONG_CROP_SUSPECTED' WHEN reg < 0.6 THEN 'ESCALATE|CROP_RECOVERY|LOW_REGISTRATION_CONFIDENCE' WHEN contra THEN 'HUMAN_REVIEW_REQUIRED|HUMAN_REVIEW|REFERENCE_CONTRADICTION'
  WHEN NOT valid AND NOT blocks AND NOT rev THEN 'UNRESOLVED_NON_BLOCKING|NONE|NON_BLOCKING_FIELD' WHEN NOT valid AND NOT has THEN 'ESCALATE|CROP_RECOVERY|EMPTY_CROP' WHEN NOT valid THEN 'ESCALATE|' || coalesce(gap, 'HUMAN_REVIEW') || '|INVALID_FORMAT' WHEN crit AND NOT cal THEN 'HUMAN_REVIEW_REQUIRED|HUMAN_REVIEW|CALIBRATION_REQUIRED_FOR_CRITICAL_ACCEPTANCE'
  WHEN dec = 'ACCEPT' AND met THEN 'AUTO_ACCEPTED|NONE|ACCEPTED' WHEN dec = 'REFERENCE_CONFIRMED' AND met THEN 'REFERENCE_CONFIRMED|NONE|CONFIRMED' WHEN dec IN ('ACCEPT', 'REFERENCE_CONFIRMED') THEN CASE WHEN coalesce(gap, 'HUMAN_REVIEW') = 'HUMAN_REVIEW' THEN 'HUMAN_REVIEW_REQUIRED|HUMAN_REVIEW' ELSE 'ESCALATE|' || gap END || '|EVIDENCE_GAP'
  WHEN NOT blocks AND NOT rev THEN 'UNRESOLVED_NON_BLOCKING|NONE|NON_BLOCKING_FIELD' WHEN dec = 'ESCALATE' AND met THEN 'HUMAN_REVIEW_REQUIRED|HUMAN_REVIEW|CALIBRATION_OR_AMBIGUITY_REQUIRES_REVIEW' WHEN dec = 'ESCALATE' THEN CASE WHEN coalesce(gap, 'HUMAN_REVIEW') = 'HUMAN_REVIEW' THEN 'HUMAN_REVIEW_REQUIRED|HUMAN_REVIEW' ELSE 'ESCALATE|' || gap END || '|EVIDENCE_GAP'
  WHEN dec = 'ABSTAIN' THEN 'INSUFFICIENT_EVIDENCE|HUMAN_REVIEW|ABSTAINED' ELSE 'HUMAN_REVIEW_REQUIRED|HUMAN_REVIEW|UNDECIDED' END AS x FROM r)
SELECT grp, split_part(x, '|', 1) AS disposition, split_part(x, '|', 2) AS action, split_part(x, '|', 3) AS reason, count(*) AS n FROM d GROUP BY ALL""")
def field_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields come to which disposition, action and reason, down the whole ladder."""
    c = F.col
    part, supp = c("l_partkey"), c("l_suppkey")
    decision = F.when(part % 5 == 0, "ACCEPT").when(part % 5 == 1, "REFERENCE_CONFIRMED").when(part % 5 == 2, "ESCALATE").when(part % 5 == 3, "ABSTAIN").otherwise("HITL")
    out = ladders.field_disposition(
        supp % 23 != 0, supp % 19 == 0, F.when(part % 5 != 0, 1 - c("l_discount") * 5), part % 31 == 0, c("l_quantity") > 5, c("l_quantity") > 2, c("l_returnflag") == "R", c("l_linenumber") > 1, decision, c("l_tax") < 0.05, c("l_linestatus") == "F", supp % 2 == 0,
        F.when(supp % 3 == 0, "HUMAN_REVIEW").when(supp % 3 == 1, "REFERENCE_LOOKUP"),
    )
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 97).alias("grp"), out.alias("d"))
    return rows.groupBy("grp", "d.disposition", "d.action", "d.reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT o_orderpriority AS run, o_orderkey AS claim, o_orderstatus AS segment, o_custkey % 40 = 0 AS review, 20 AS evaluated, 20 - CAST(o_custkey % 50 = 0 AS INTEGER) AS correct, 10 AS ec, 10 - CAST(o_custkey % 90 = 0 AS INTEGER) AS cc, 15 AS accepted, 15 - CAST(o_custkey % 70 = 0 AS INTEGER) AS ca, 8 AS ac, 8 AS cac, CAST(o_custkey % 70 = 0 AS INTEGER) AS fa, CAST(o_custkey % 3 = 0 AS INTEGER) AS wc, CAST(o_custkey % 3 = 0 AND o_custkey % 100 <> 0 AS INTEGER) AS wd, o_custkey % 11 AS src, o_orderpriority <> '5-LOW' AS parity FROM orders),
g AS (SELECT run, segment, count(*) AS n, count(*) FILTER (WHERE review) AS r FROM o GROUP BY 1, 2), w AS (SELECT run, max(CAST(r AS DOUBLE) / n) AS worst FROM g GROUP BY 1),
s AS (SELECT run, count(*) AS claims, CAST(count(*) FILTER (WHERE review) AS DOUBLE) AS r, sum(correct)::DOUBLE / sum(evaluated) AS accuracy, sum(cc)::DOUBLE / sum(ec) AS cacc, sum(ca)::DOUBLE / sum(accepted) AS prec, sum(fa)::DOUBLE / sum(accepted) AS far, sum(ac) AS ac, sum(cac)::DOUBLE / sum(ac) AS cprec, sum(wd)::DOUBLE / sum(wc) AS recall, bool_and(parity) AS parity, count(*) FILTER (WHERE src = 7) AS taught FROM o GROUP BY 1),
b AS (SELECT *, r / claims AS rate, (r / claims + 3.841458820694124 / (2 * claims) + 1.959963984540054 * sqrt(r / claims * (1 - r / claims) / claims + 3.841458820694124 / (4 * CAST(claims AS DOUBLE) * claims))) / (1 + 3.841458820694124 / claims) AS upper FROM s JOIN w USING (run))
SELECT run, claims, round(rate, 9) AS review_rate, round(upper, 9) AS review_upper, round(worst, 9) AS worst_segment, round(accuracy, 9) AS accuracy, round(far, 9) AS false_accept_rate, concat_ws(',', CASE WHEN taught > 0 THEN 'SOURCE_DISJOINT' END, CASE WHEN claims < 1000 THEN 'MINIMUM_CLAIMS' END, CASE WHEN ac < 3000 THEN 'MINIMUM_ACCEPTED_CRITICAL_FIELDS' END, CASE WHEN accuracy < 0.95 THEN 'OVERALL_RAW_ACCURACY' END, CASE WHEN cacc < 0.98 THEN 'CRITICAL_RAW_ACCURACY' END, CASE WHEN prec < 0.995 THEN 'ACCEPTED_PRECISION' END,
 CASE WHEN rate > 0.08 THEN 'CLAIM_HITL' END, CASE WHEN upper >= 0.10 THEN 'CLAIM_HITL_UPPER_95' END, CASE WHEN worst > 0.15 THEN 'SEGMENT_CLAIM_HITL' END, CASE WHEN far > 0.001 THEN 'FALSE_ACCEPT_RATE' END, CASE WHEN cprec < 0.995 THEN 'CRITICAL_ACCEPTED_PRECISION' END, CASE WHEN coalesce(recall, 0) < 0.95 THEN 'WRONG_CROP_RECALL' END, CASE WHEN NOT parity THEN 'RUNTIME_PARITY' END) AS failed FROM b""")
def shadow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadow runs against all gates for going live."""
    k = F.col("o_custkey")
    flag = lambda c: c.cast("int")
    counts = {"evaluated": F.lit(20), "correct": 20 - flag(k % 50 == 0), "evaluated_critical": F.lit(10), "correct_critical": 10 - flag(k % 90 == 0), "accepted": F.lit(15), "correct_accepted": 15 - flag(k % 70 == 0), "accepted_critical": F.lit(8), "correct_accepted_critical": F.lit(8), "false_accepts": flag(k % 70 == 0), "critical_false_accepts": F.lit(0), "wrong_crops": flag(k % 3 == 0), "wrong_crops_detected": flag((k % 3 == 0) & (k % 100 != 0))}
    flags = {"locked_holdout": F.lit(True), "runtime_parity": F.col("o_orderpriority") != "5-LOW", "route_governance": F.lit(True), "shadow_only": F.lit(True)}
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("claim"), F.col("o_orderstatus").alias("segment"), F.concat(F.lit("s"), (k % 11).cast("string")).alias("source_group"), (k % 40 == 0).alias("review"), *(c.alias(n) for n, c in {**counts, **flags}.items()))
    out = ladders.shadow_gates(claims, "run", prohibited=["s7"])
    return out.select("run", "claims", *(F.round(c, 9).alias(c) for c in ("review_rate", "review_upper", "worst_segment", "accuracy", "false_accept_rate")), F.array_join("failed", ",").alias("failed"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'PAGE' ELSE 'FIELD_CROP' END AS scope, user_id % 3 AS src, event_type, event_id % 2 = 0 AS blocker, event_id % 5 = 0 AS unlocks, event_id % 11 <> 0 AS safe, value > 60 AS resolved FROM events),
f AS (SELECT *, CASE WHEN scope <> 'FIELD_CROP' THEN 'FULL_PAGE_REJECTED' WHEN src = 2 THEN 'SOURCE_NOT_ELIGIBLE' WHEN event_type = 'signup' THEN 'FAMILY_NOT_ELIGIBLE' WHEN NOT blocker AND NOT unlocks THEN 'NO_CLAIM_UNLOCK_IMPACT' WHEN NOT safe THEN 'UNSAFE_CROP' WHEN resolved THEN 'VALID_PRIMARY_BYPASS' WHEN event_type = 'error' THEN 'FAILURE_REASON_NOT_ELIGIBLE' END AS refusal FROM e),
b AS (SELECT CASE WHEN count(*) FILTER (WHERE blocker) = 0 THEN 0 ELSE greatest(1, floor(count(*) FILTER (WHERE blocker) * 0.3e0)) END AS cap FROM e), r AS (SELECT *, sum(CAST(refusal IS NULL AS INTEGER)) OVER (ORDER BY event_id) AS k FROM f, b)
SELECT event_id, refusal IS NULL AND k <= cap AS granted, coalesce(refusal, CASE WHEN k <= cap THEN 'BLOCKER_CHALLENGE' ELSE 'INVOCATION_BUDGET_EXHAUSTED' END) AS reason FROM r""")
def challenger_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields are put to a challenger, within a budget over all of them."""
    k, kind = F.col("event_id"), F.col("event_type")
    scope, source = F.when(k % 13 == 0, "PAGE").otherwise("FIELD_CROP"), F.when(F.col("user_id") % 3 == 2, "SOURCE_A").otherwise("SOURCE_B")
    family, failure = F.when(kind == "signup", "OTHER").otherwise("UB04"), F.when(kind == "error", "TIMEOUT").otherwise("EMPTY")
    refusal = ladders.challenge_refusal(scope, source, family, k % 2 == 0, k % 5 == 0, k % 11 != 0, F.col("value") > 60, failure, ("EMPTY",))
    asked = table(spark, sf_dir, "events").select("event_id", refusal.alias("refusal"), (k % 2 == 0).alias("blocker"))
    return ladders.challenges(asked, "refusal", F.col("blocker"), ["event_id"]).select("event_id", "granted", "reason")


@query("""WITH a AS (SELECT doc_id, lang, source, n_chars FROM documents), p AS (SELECT x.doc_id AS a_id, y.doc_id AS b_id, CASE x.doc_id % 3 WHEN 0 THEN 'member_id' WHEN 1 THEN 'patient_name' ELSE 'other' END AS field, x.lang AS xv, y.lang AS yv, CASE x.doc_id % 4 WHEN 0 THEN 'subscriber' WHEN 1 THEN 'patient' ELSE 'claim_header' END AS xs, CASE y.doc_id % 4 WHEN 0 THEN 'subscriber' WHEN 1 THEN 'patient' ELSE 'claim_header' END AS ys,
 x.source AS xc, y.source AS yc, x.n_chars % 7 AS xr, y.n_chars % 7 AS yr FROM a x JOIN a y ON y.doc_id = x.doc_id + 1),
q AS (SELECT *, xs <> ys AS two, xc <> yc AND xr <> yr AS apart, (field = 'member_id' AND ((xs = 'subscriber' AND ys = 'claim_header') OR (ys = 'subscriber' AND xs = 'claim_header'))) OR (field = 'patient_name' AND ((xs = 'patient' AND ys = 'subscriber') OR (ys = 'patient' AND xs = 'subscriber'))) AS fits FROM p)
SELECT a_id, b_id, apart AND two AS independent, apart AND two AND fits AS compatible, apart AND two AND fits AND coalesce(xv = yv, false) AS agreeing, concat_ws(',', CASE WHEN xc = yc OR (xc IS NULL AND yc IS NULL) THEN 'SAME_CROP_SHA256' END, CASE WHEN xr = yr THEN 'SAME_LOCALIZATION_REGION' END, CASE WHEN NOT two THEN 'SEMANTIC_SECTION_NOT_DISTINCT' END, CASE WHEN two AND NOT fits THEN 'SEMANTIC_SECTIONS_INCOMPATIBLE' END, CASE WHEN apart AND two AND fits AND xv <> yv THEN 'MATERIAL_VALUE_CONFLICT' END) AS reasons FROM q""")
def pair_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What neighbouring documents' readings of a field are to each other."""
    k = F.col("doc_id")
    reading = F.struct(F.col("lang").alias("value"), F.when(k % 4 == 0, "subscriber").when(k % 4 == 1, "patient").otherwise("claim_header").alias("section"), k.cast("string").alias("invocation"), F.col("source").alias("crop"), (F.col("n_chars") % 7).cast("string").alias("region"), F.lit("p").alias("page"), k.cast("string").alias("document"), F.array().cast("array<string>").alias("shared"))
    d = table(spark, sf_dir, "documents").select("doc_id", reading.alias("reading"))
    pairs = d.select(k.alias("a_id"), F.col("reading").alias("left"), (k + 1).alias("b_id")).join(d.select(k.alias("b_id"), F.col("reading").alias("right")), "b_id")
    field = F.when(F.col("a_id") % 3 == 0, "member_id").when(F.col("a_id") % 3 == 1, "patient_name").otherwise("other")
    out = ladders.pair_assessment(field, F.col("left"), F.col("right"))
    return pairs.select("a_id", "b_id", out.alias("o")).select("a_id", "b_id", "o.independent", "o.compatible", "o.agreeing", F.array_join("o.reasons", ",").alias("reasons"))
