"""Policies, candidate rules and geometry, each by the operator of that name over stand-in columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import candidates as c
from ..operators import governance, metrics, policies
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'NON_CLAIM' ELSE 'CLAIM' END AS top, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'REJECTED' END AS v, o_orderpriority AS family, o_custkey % 3 = 0 AS s, o_custkey % 3 = 1 AS r, o_custkey % 11 <> 0 AS leave FROM orders)
SELECT o_orderkey AS document, CASE WHEN top = 'NON_CLAIM' THEN 'STOP_NON_CLAIM' WHEN v = 'VERIFIED' AND NOT leave THEN NULL WHEN v = 'VERIFIED' AND family = '1-URGENT' THEN 'CMS_STANDARD_EXTRACTOR' WHEN v = 'VERIFIED' THEN 'UB_STANDARD_EXTRACTOR' WHEN s THEN 'LAYOUT_STRUCTURED_EXTRACTOR' WHEN r THEN 'UNSTRUCTURED_EXTRACTOR' ELSE 'SAFE_UNKNOWN' END AS route,
 CASE WHEN top = 'NON_CLAIM' THEN 'TOP_LEVEL_NON_CLAIM' WHEN v = 'VERIFIED' AND NOT leave THEN 'VERIFIED_WITHOUT_LEAVE_FOR_FIXED_EXTRACTOR' WHEN v = 'VERIFIED' THEN 'STANDARD_FORM_VERIFIED' WHEN s THEN 'STRUCTURED_WITHOUT_STANDARD_VERIFICATION' WHEN r THEN 'UNSTRUCTURED_CLAIM_RELATED' ELSE 'INSUFFICIENT_SAFE_ROUTE_EVIDENCE' END AS reason FROM r""")
def processing_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_custkey") % 3
    top, family = F.when(F.col("o_orderkey") % 7 == 0, "NON_CLAIM").otherwise("CLAIM"), F.when(F.col("o_orderpriority") == "1-URGENT", "CMS1500").otherwise("UB04")
    verified = F.when(F.col("o_orderstatus") == "F", "VERIFIED").when(F.col("o_orderstatus") == "O", "REJECTED")
    return o.select(F.col("o_orderkey").alias("document"), policies.processing_route(top, verified, family, key == 0, key == 1, F.col("o_custkey") % 11 != 0).alias("r")).select("document", "r.route", "r.reason")


@query("""SELECT event_id, (user_id % 2 = 0 AND event_id % 3 = 0 AND value >= 0.9) OR (event_id % 5 = 0 AND value / 2 >= 0.85) AS accepted FROM events""")
def reference_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = table(spark, sf_dir, "events"), F.col("value")
    return e.select("event_id", policies.reference_accepted(F.col("user_id") % 2 == 0, F.col("event_id") % 3 == 0, v, F.col("event_id") % 5 == 0, v / 2).alias("accepted"))


@query("""WITH a AS (SELECT user_id, list_distinct(list(CASE event_type WHEN 'login' THEN 'po_box' WHEN 'view' THEN 'postal_code' WHEN 'click' THEN 'city' ELSE 'state' END)) AS m FROM events GROUP BY 1)
SELECT user_id, user_id % 11 <> 0 AND len(list_intersect(m, ['po_box', 'postal_code', 'city', 'state'])) = 4 AND user_id % 5 <> 0 AS accepted FROM a""")
def address_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of members that all needed attributes confirm and none contradicts."""
    name = F.when(F.col("event_type") == "login", "po_box").when(F.col("event_type") == "view", "postal_code").when(F.col("event_type") == "click", "city").otherwise("state")
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(name).alias("m"))
    against = F.when(F.col("user_id") % 5 == 0, F.array(F.lit("city"))).otherwise(F.array().cast("array<string>"))
    return a.select("user_id", policies.address_accepted(F.col("user_id") % 11 != 0, F.lit(True), F.lit(True), F.col("m"), against, F.lit("x")).alias("accepted"))


_ANY_OF = [["login", "view"], ["purchase"]]


@query("""WITH a AS (SELECT user_id, list_distinct(list(event_type) FILTER (WHERE event_id % 3 = 0)) AS s FROM events GROUP BY 1), u AS (SELECT user_id, coalesce(list_contains(s, 'login') AND list_contains(s, 'view'), false) AS x, coalesce(list_contains(s, 'purchase'), false) AS y FROM a)
SELECT user_id, x OR y AS passed, concat_ws(';', CASE WHEN NOT x THEN 'login+view' END, CASE WHEN NOT y THEN 'purchase' END) AS missing FROM u""")
def signal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives of signals: whether one is met, and all that aren't."""
    signal = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))  # other events are no signal
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(signal).alias("s"))
    rule = policies.signal_rule(F.array(*(F.array(*map(F.lit, o)) for o in _ANY_OF)), F.col("s"))
    return a.select("user_id", rule.alias("r")).select("user_id", "r.passed", F.array_join("r.missing", ";").alias("missing"))


@query("""SELECT page_id, length(html) > 9000 OR (contains(html, '<ul>') AND page_id % 3 = 0 AND page_id % 2 = 0) AS due FROM pages""")
def table_reader_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the reader of tables looks at."""
    key = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", policies.table_reader_due(F.length("html") > 9000, F.contains("html", F.lit("<ul>")), key % 3 == 0, key % 2 == 0).alias("due"))


@query("""SELECT o_orderkey AS document, CASE WHEN o_orderstatus <> 'F' THEN 'REGISTERED_FIXED_REQUIRES_VERIFIED_FORM_IDENTITY' WHEN o_orderkey % 5 = 0 OR o_orderkey % 6 = 0 THEN 'REGISTERED_FIXED_REQUIRES_COMPATIBLE_TEMPLATE' WHEN o_orderkey % 7 = 0 THEN 'REGISTERED_FIXED_REQUIRES_ACCEPTED_REGISTRATION'
 WHEN o_totalprice < 50000 THEN 'REGISTERED_FIXED_REQUIRES_VALID_TRANSFORMED_GEOMETRY' WHEN o_custkey % 4 = 0 THEN 'REGISTERED_FIXED_REQUIRES_TEMPLATE_LINEAGE' END AS refusal FROM orders""")
def fixed_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a document's fixed regions may not be used."""
    key = F.col("o_orderkey")
    compatibility = F.when(key % 5 == 0, "INCOMPATIBLE").when(key % 6 != 0, "COMPATIBLE")
    refusal = policies.fixed_geometry_refusal(F.when(F.col("o_orderstatus") == "F", "VERIFIED"), compatibility, key % 7 != 0, F.col("o_totalprice") >= 50000, F.lit(True), F.when(F.col("o_custkey") % 4 != 0, "T1"), F.lit("1"))
    return table(spark, sf_dir, "orders").select(key.alias("document"), refusal.alias("refusal"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_discount, l_returnflag FROM lineitem), t AS (SELECT *, CASE WHEN l_returnflag = 'R' OR l_linenumber > 5 THEN 'LOCAL_ONLY' WHEN l_suppkey % 5 = 0 THEN 'LOCAL_ONLY' WHEN l_partkey % 2 = 0 AND (l_partkey % 3 = 0 OR l_suppkey % 4 = 0) THEN 'LOCAL_ONLY' WHEN l_partkey % 2 = 0 THEN 'FIELD_CROP' ELSE 'TEXT' END AS tier,
 CASE WHEN l_returnflag = 'R' OR l_linenumber > 5 THEN 'TIER0_LOCAL_RESULT' WHEN l_suppkey % 5 = 0 THEN 'AUTHORITATIVE_CONFLICT_PROTECTED' WHEN l_partkey % 2 = 0 AND (l_partkey % 3 = 0 OR l_suppkey % 4 = 0) THEN 'TIER2_INELIGIBLE' ELSE 'ROUTED' END AS reason FROM f)
SELECT tier, reason, count(*) AS n FROM t GROUP BY 1, 2""")
def adjudication_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far fields are taken beyond local results."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    tier = policies.adjudication_tier(F.lit(True), F.col("l_returnflag") == "R", F.col("l_linenumber") <= 5, supplier % 5 == 0, part % 2 == 0, part % 3 != 0, supplier % 4 != 0)
    return table(spark, sf_dir, "lineitem").select(tier.alias("t")).groupBy("t.tier", "t.reason").agg(F.count(F.lit(1)).alias("n"))


_ROUTE = [{"action": "view", "cost": 0.0, "seconds": 1.0}, {"action": "REFERENCE", "cost": 0.1, "seconds": 1.0, "reference": True}, {"action": "CLOUD", "cost": 2.0, "seconds": 5.0, "cloud": True}]


@query("""WITH a AS (SELECT user_id, coalesce(list_distinct(list(event_type) FILTER (WHERE event_id % 4 = 0)), []) AS tried, CAST(count(*) FILTER (WHERE event_id % 4 = 0) AS DOUBLE) / 10 AS budget FROM events GROUP BY 1),
w AS (SELECT *, CASE WHEN list_contains(tried, 'view') THEN 'tried' WHEN budget < 0 THEN 'budget_exceeded' ELSE '' END AS v, CASE WHEN user_id % 3 <> 0 THEN 'reference_unavailable' WHEN budget < 0.1 THEN 'budget_exceeded' ELSE '' END AS r, CASE WHEN user_id % 2 = 0 THEN 'cloud_processing_disallowed' WHEN budget < 2 THEN 'budget_exceeded' ELSE '' END AS c FROM a)
SELECT user_id, CASE WHEN v = '' THEN 'view' WHEN r = '' THEN 'REFERENCE' WHEN c = '' THEN 'CLOUD' WHEN list_contains(tried, 'signup') THEN 'ABSTAIN' ELSE 'HITL' END AS action,
 CASE WHEN v = '' OR r = '' THEN '' WHEN c = '' THEN r ELSE array_to_string(list_sort(list_distinct([r, c])), ';') END AS skipped FROM w""")
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest next source of evidence that a member's limits allow."""
    attempt = F.col("event_id") % 4 == 0
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(attempt, F.col("event_type"))).alias("tried"), (F.count_if(attempt).cast("double") / 10).alias("budget"))
    tried = F.when(F.array_contains("tried", "signup"), F.array_append("tried", F.lit("HITL"))).otherwise(F.col("tried"))
    step = policies.next_action(_ROUTE, tried, F.col("budget"), F.lit(60.0), F.col("user_id") % 2 == 1, F.col("user_id") % 3 == 0)
    return a.select("user_id", step.alias("s")).select("user_id", "s.action", F.array_join("s.skipped", ";").alias("skipped"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, bool_and(l_linestatus = 'F') AS ok FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1, 2), k AS (SELECT l_orderkey, count(*) FILTER (WHERE ok) AS closed FROM f GROUP BY 1)
SELECT o_orderkey AS claim, coalesce(closed, 0) = 3 AS can_finalize, 3 - coalesce(closed, 0) AS open FROM orders LEFT JOIN k ON o_orderkey = l_orderkey""")
def claims_to_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims all of whose critical fields are settled; missing ones are open."""
    state = F.when(F.col("l_linestatus") == "F", "VALIDATED_AUTOMATICALLY").otherwise("CONFLICT")
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").cast("string").alias("field"), state.alias("state"))
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"))
    return policies.finalizable(fields, claims, ["1", "2", "3"], "claim", "field", "state")


@query("""WITH d AS (SELECT user_id, CASE WHEN event_id % 6 < 2 THEN event_type ELSE 'other' END AS g, CASE WHEN event_id % 5 = 0 THEN 'FAIL' WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'PASS' END AS s FROM events),
w AS (SELECT user_id, g, min(CASE s WHEN 'PASS' THEN 'PASS' WHEN 'FAIL' THEN 'FAIL' ELSE 'NOT_TESTED' END) AS s FROM d WHERE g IN ('login', 'view') GROUP BY 1, 2), k AS (SELECT user_id, count(*) FILTER (WHERE s = 'PASS') AS p, count(*) FILTER (WHERE s = 'FAIL') AS f FROM w GROUP BY 1)
SELECT u.user_id, CASE WHEN p = 2 THEN 'PROMOTABLE' ELSE 'BLOCKED' END AS decision, coalesce(f, 0) AS failed, 2 - coalesce(p, 0) - coalesce(f, 0) AS untested FROM (SELECT DISTINCT user_id FROM d) u LEFT JOIN k USING (user_id)""")
def release_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all gates of a candidate are declared passed."""
    said = F.when(F.col("event_id") % 5 == 0, "FAIL").when(F.col("event_id") % 7 == 0, "unknown").otherwise(" tested")
    gate = F.when(F.col("event_id") % 6 < 2, F.col("event_type")).otherwise("other")
    d = table(spark, sf_dir, "events").select("user_id", gate.alias("gate"), said.alias("value"))
    return policies.declared_gates(d, ["login", "view"], "user_id", "gate", "value")


@query("""WITH e AS (SELECT p_partkey, p_brand AS expected, CASE WHEN p_size % 5 = 0 THEN replace(p_brand, '1', 'l') WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS selected, CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_brand END AS raw, CASE WHEN p_size % 13 = 0 THEN 'WRONG_REGION' WHEN p_size % 17 = 0 THEN 'UNDER_CROP' ELSE 'VALUE_CONTAINED' END AS outcome, p_size FROM part),
s AS (SELECT *, 1 - CAST(levenshtein(coalesce(selected, raw), expected) AS DOUBLE) / greatest(length(coalesce(selected, raw)), length(expected)) AS sim, coalesce(selected <> expected, TRUE) AS wrong FROM e)
SELECT p_partkey, CASE WHEN outcome = 'WRONG_REGION' THEN 'LOCALIZATION_WRONG' WHEN outcome = 'UNDER_CROP' THEN 'UNDER_CROP' WHEN trim(raw) = '' THEN 'OCR_EMPTY' WHEN p_size % 3 = 0 AND wrong THEN 'CANDIDATE_RANKING_ERROR' WHEN p_size % 2 = 0 AND wrong THEN 'SPAN_SELECTION_ERROR' WHEN p_size < 40 AND wrong THEN 'NORMALIZATION_ERROR' WHEN sim >= 0.7 THEN 'OCR_CHARACTER_ERROR' ELSE 'OCR_WORD_ERROR' END AS cause FROM s""")
def extraction_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cause of each wrong value; likeness by edit distance, so that SQL has it."""
    size, expected = F.col("p_size"), F.col("p_brand")
    selected = F.when(size % 5 == 0, F.replace(expected, F.lit("1"), F.lit("l"))).when(size % 7 != 0, expected)
    raw, outcome = F.when(size % 11 == 0, " ").otherwise(expected), F.when(size % 13 == 0, "WRONG_REGION").when(size % 17 == 0, "UNDER_CROP").otherwise("VALUE_CONTAINED")
    seen = F.coalesce(selected, raw)
    similarity = 1 - F.levenshtein(seen, expected).cast("double") / F.greatest(F.length(seen), F.length(expected))
    cause = policies.extraction_failure(outcome, raw, selected, expected, F.when(size < 40, expected), size % 3 == 0, size % 2 == 0, similarity)
    return table(spark, sf_dir, "part").select("p_partkey", cause.alias("cause"))


@query("""SELECT user_id, count(*) AS blockers, greatest(1, CAST(floor(count(*) * 0.3) AS BIGINT)) AS most FROM events GROUP BY 1""")
def challenger_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("blockers"))
    return a.select("user_id", "blockers", policies.challenger_limit(F.col("blockers"), 0.3).alias("most"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 7 = 0 AS foreign_, l_suppkey % 9 = 0 AS own, l_partkey % 11 = 0 AS extra, l_tax AS margin, l_quantity > 2 AS tokens, 1 - l_discount * 6 AS geometry, l_quantity / 50.0 AS span, l_tax * 10 AS semantic FROM lineitem),
o AS (SELECT *, CASE WHEN foreign_ THEN 'WRONG_NEIGHBOR' WHEN own THEN 'LABEL_CONTAMINATED' WHEN extra THEN 'MULTI_FIELD_CROP' WHEN margin < 0.025 THEN 'REGION_AMBIGUOUS' WHEN NOT tokens THEN 'UNKNOWN' WHEN geometry < 0.5 THEN 'UNKNOWN' ELSE 'REGION_OWNED' END AS ownership FROM r)
SELECT ownership, count(*) AS n, count(*) FILTER (WHERE ownership = 'REGION_OWNED' AND l_partkey % 2 = 0) AS usable, round(sum(CASE WHEN foreign_ THEN 0.98 WHEN own THEN 0.96 WHEN extra THEN 0.94 WHEN margin < 0.025 THEN 0.90 WHEN NOT tokens THEN 0.25 WHEN geometry < 0.5 THEN 0.40 ELSE least(0.99, CASE WHEN semantic < 0.20 THEN 0.72 ELSE 0.99 END, 0.50 + geometry * 0.25 + span * 0.15) END), 4) AS confidence FROM o GROUP BY 1""")
def region_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who owns a located region, how surely, and how many regions can be used."""
    count = lambda holds: F.when(holds, 1).otherwise(0)
    owner = policies.region_ownership(count(F.col("l_linenumber") % 7 == 0), count(F.col("l_suppkey") % 9 == 0), count(F.col("l_partkey") % 11 == 0), F.col("l_tax"), count(F.col("l_quantity") > 2), 1 - F.col("l_discount") * 6, F.col("l_quantity") / 50.0, F.lit(None).cast("double"), F.col("l_tax") * 10)
    r = table(spark, sf_dir, "lineitem").select("l_partkey", owner.alias("o")).select("l_partkey", "o.ownership", "o.confidence")
    usable = policies.region_usable(F.lit("VALUE_CONTAINED"), F.col("ownership"), F.col("l_partkey") % 2 != 0, F.lit(False), F.lit(False))
    return r.groupBy("ownership").agg(F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("usable"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("""WITH s AS (SELECT l_orderkey, l_partkey, max(1 - l_discount) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey))
SELECT l_orderkey AS page, l_partkey AS template, score, CASE WHEN score >= 0.75 AND score - coalesce(second, 0) >= 0.02 THEN 'SELECTED' ELSE 'UNRESOLVED' END AS status FROM r WHERE k = 1""")
def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's template, where one is good and ahead of the next."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("template")).agg(F.max(1 - F.col("l_discount")).alias("score"))
    return policies.chosen_template(s, "page", "template", "score", margin=0.02)


@query("""WITH c AS (SELECT l_orderkey AS document, CAST(l_linenumber % 3 AS VARCHAR) AS field, l_returnflag AS value, l_suppkey % 3 AS page, round(0.35 * (1 - l_discount) + 0.25 * (1 - l_tax) + 0.25 * l_quantity / 50 + 0.15 * 0.9, 9) AS score, l_linestatus = 'F' AS valid FROM lineitem), q AS (SELECT * FROM (VALUES ('0', true), ('1', false), ('2', true)) t(field, critical)),
v AS (SELECT *, row_number() OVER (PARTITION BY document, field, page ORDER BY score DESC, value) AS j FROM c WHERE valid AND value <> ''), r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM v WHERE j = 1 WINDOW w AS (PARTITION BY document, field ORDER BY score DESC, page)),
o AS (SELECT d.document, q.field, q.critical, r.page, r.value, CASE WHEN score IS NULL THEN 'no_page_candidate_passed_hard_validation' WHEN score < 0.70 THEN 'best_page_evidence_below_threshold' WHEN round(score - second, 9) < 0.08 THEN 'winning_page_margin_below_threshold' ELSE 'selected_page_' || r.page || '_for_' || q.field END AS reason
 FROM (SELECT DISTINCT document FROM c) d CROSS JOIN q LEFT JOIN r ON r.document = d.document AND r.field = q.field AND k = 1)
SELECT document, field, CASE WHEN reason LIKE 'selected%' THEN page END AS page, CASE WHEN reason LIKE 'selected%' THEN value END AS value, reason, critical AND reason NOT LIKE 'selected%' AS review FROM o""")
def field_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each required field of a document the page that stands out, and what is read there."""
    score = F.round(policies.page_evidence(1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_quantity") / 50, F.lit(0.9)), 9)
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), (F.col("l_linenumber") % 3).cast("string").alias("field"), F.col("l_returnflag").alias("value"), (F.col("l_suppkey") % 3).alias("page"), score.alias("score"), (F.col("l_linestatus") == "F").alias("valid"))
    required = spark.createDataFrame([("0", True), ("1", False), ("2", True)], "field string, critical boolean")
    return policies.routed_fields(found, required, "document", "field", "critical", "score", "page", "value", F.col("valid"))


@query("""WITH f AS (SELECT l_orderkey AS claim, 1 - l_discount AS c, l_linenumber <= 2 AS crit, l_quantity > 3 AS p FROM lineitem), a AS (SELECT claim, CAST(count(*) FILTER (WHERE p) AS DOUBLE) / count(*) AS completeness, min(CASE WHEN crit THEN CASE WHEN p THEN c ELSE 0 END END) AS weakest_critical, min(CASE WHEN p THEN c END) AS weakest FROM f GROUP BY 1)
SELECT claim, completeness, weakest_critical, least(completeness, coalesce(weakest_critical, 1), coalesce(weakest, 0)) AS quality, concat_ws(',', CASE WHEN completeness < 1 THEN 'INCOMPLETE' END, CASE WHEN coalesce(weakest_critical, 1) < 0.95 THEN 'CRITICAL_CONFIDENCE_LOW' END) AS reasons FROM a""")
def claim_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim's weakest part and what keeps it from safe processing."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), (1 - F.col("l_discount")).alias("c"), (F.col("l_linenumber") <= 2).alias("crit"), (F.col("l_quantity") > 3).alias("p"))
    return policies.claim_quality(f, "claim", "c", "crit", "p")


@query("""WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(1000000000 + event_id AS VARCHAR) WHEN 1 THEN '$' || CAST(user_id AS VARCHAR) || '.50' WHEN 2 THEN event_type WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN 'AB' || CAST(event_id AS VARCHAR) ELSE ' ' END AS value,
 CASE event_id % 5 WHEN 0 THEN 'NPI' WHEN 1 THEN 'CURRENCY' WHEN 2 THEN 'TEXT' WHEN 3 THEN 'DATE' ELSE 'ALPHANUMERIC_ID' END AS kind FROM events)
SELECT kind, grade, count(*) AS n FROM (SELECT kind, CAST(CASE WHEN trim(value) = '' THEN 0 WHEN kind = 'NPI' THEN CASE WHEN length(regexp_replace(value, '[^0-9]', '', 'g')) = 10 THEN 1 ELSE 0 END WHEN kind = 'CURRENCY' THEN CASE WHEN regexp_full_match(value, '\\$?[0-9][0-9,]*(\\.[0-9]{1,2})?') THEN 1 ELSE 0.1 END
 WHEN kind = 'TEXT' THEN CASE WHEN NOT regexp_matches(value, '[A-Za-z]') THEN 0 ELSE 0.8 END WHEN kind = 'ALPHANUMERIC_ID' THEN CASE WHEN regexp_full_match(value, '[A-Za-z0-9-]{5,24}') THEN 0.95 ELSE 0.15 END
 ELSE CASE WHEN TRY_CAST(CASE WHEN regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN value END AS DATE) IS NOT NULL OR (length(regexp_replace(value, '[^0-9]', '', 'g')) = 8 AND (try_strptime(regexp_replace(value, '[^0-9]', '', 'g'), '%Y%m%d') IS NOT NULL OR try_strptime(regexp_replace(value, '[^0-9]', '', 'g'), '%m%d%Y') IS NOT NULL)) THEN 1 ELSE 0 END END AS DOUBLE) AS grade FROM v) GROUP BY 1, 2""")
def type_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well values suit the datatypes they are read as."""
    e, six, five = table(spark, sf_dir, "events"), F.col("event_id") % 6, F.col("event_id") % 5
    number = lambda x: x.cast("string")
    value = F.when(six == 0, number(F.lit(1000000000) + F.col("event_id"))).when(six == 1, F.concat(F.lit("$"), number(F.col("user_id")), F.lit(".50"))).when(six == 2, F.col("event_type")).when(six == 3, F.date_format("ts", "yyyy-MM-dd")).when(six == 4, F.concat(F.lit("AB"), number(F.col("event_id")))).otherwise(" ")
    kind = F.when(five == 0, "NPI").when(five == 1, "CURRENCY").when(five == 2, "TEXT").when(five == 3, "DATE").otherwise("ALPHANUMERIC_ID")
    return e.select(kind.alias("kind"), c.type_compatibility(value, kind, F.lit("x")).alias("grade")).groupBy("kind", "grade").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'st. ' || p_name || '!' WHEN 1 THEN 'city of ' || p_name WHEN 2 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS city, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size + 10 AS VARCHAR) || '( main   st . 5' WHEN 1 THEN CAST(p_size + 10 AS VARCHAR) || ' oak road' ELSE p_name END AS addr, p_partkey % 3 AS k, p_size FROM part),
k AS (SELECT *, upper(trim(regexp_replace(regexp_replace(city, '[^A-Za-z .''-]', ' ', 'g'), '\\s+', ' ', 'g'), ' .''-')) AS v FROM p)
SELECT p_partkey, CASE WHEN regexp_full_match(v, '[A-Z][A-Z .''-]+') AND NOT regexp_matches(v, '\\b(PATIENT|ADDRESS|CITY|STATE|ZIP|INSURED)\\b') THEN v END AS city, CASE k WHEN 0 THEN CAST(p_size + 10 AS VARCHAR) || '2 MAIN ST' WHEN 1 THEN CAST(p_size + 10 AS VARCHAR) || ' OAK ROAD' END AS address FROM k""")
def repaired_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities and addresses as an OCR engine gives them, repaired."""
    key, size, name = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_name")
    number = (F.col("p_size") + 10).cast("string")
    city = F.when(key % 4 == 0, F.concat(F.lit("st. "), name, F.lit("!"))).when(key % 4 == 1, F.concat(F.lit("city of "), name)).when(key % 4 == 2, name).otherwise(size)
    address = F.when(key % 3 == 0, F.concat(number, F.lit("( main   st . 5"))).when(key % 3 == 1, F.concat(number, F.lit(" oak road"))).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", c.clean_city(city).alias("city"), c.repaired_address(address).alias("address"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'SAME_AS_INSURED' ELSE 'UNKNOWN' END AS state, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN c_name END AS value FROM customer""")
def same_as_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values taken over from the insured, where the patient is the insured and has none of their own."""
    key = F.col("c_custkey")
    out = c.same_as(F.when(key % 2 == 0, " ").otherwise(F.col("c_name")), F.col("c_name"), F.when(key % 3 == 0, "01").otherwise("18"), "SAME_AS_INSURED")
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("s")).select("c_custkey", "s.state", "s.value")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 20 AS q, CAST(l_quantity * 20 AS INTEGER) - 40 AS x0, CAST(l_quantity * 20 AS INTEGER) + 60 AS x1, l_linenumber * 10 AS y0, l_linenumber * 10 + 8 AS y1, l_returnflag = 'R' AS cut FROM lineitem),
e AS (SELECT CASE WHEN cut THEN greatest(0, x0 - 12) ELSE x0 END AS x0, CASE WHEN cut THEN least(1000, x1 + 12) ELSE x1 END AS x1, CASE WHEN cut THEN greatest(0, y0 - 1) ELSE y0 END AS y0, CASE WHEN cut THEN least(60, y1 + 1) ELSE y1 END AS y1 FROM b)
SELECT count(*) AS n, sum(x1 - x0) AS width, sum(y1 - y0) AS height, count(*) FILTER (WHERE least(1000, x1) > greatest(0, x0) AND least(60, y1) > greatest(0, y0)) AS inside FROM e""")
def expanded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions made wider where something is cut off, and how many lie on the page."""
    at, line = (F.col("l_quantity") * 20).cast("int"), F.col("l_linenumber").cast("int")
    box = {"x0": at - 40, "y0": line * 10, "x1": at + 60, "y1": line * 10 + 8}
    w, h = F.lit(1000), F.lit(60)
    e = table(spark, sf_dir, "lineitem").select(c.expanded(box, w, h, F.col("l_returnflag") == "R").alias("b"))
    inside = c.clipped({k: F.col(f"b.{k}") for k in box}, w, h)
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b.x1") - F.col("b.x0")).alias("width"), F.sum(F.col("b.y1") - F.col("b.y0")).alias("height"), F.count(inside).alias("inside"))


@query("""SELECT tag, CASE tag WHEN 1 THEN 'UNCOMPRESSED' WHEN 2 THEN 'CCITT_G3' WHEN 3 THEN 'CCITT_G3' WHEN 4 THEN 'CCITT_G4' WHEN 5 THEN 'LZW' WHEN 6 THEN 'JPEG' WHEN 7 THEN 'JPEG' WHEN 8 THEN 'DEFLATE' ELSE 'OTHER' END AS compression, count(*) AS n FROM (SELECT CAST(l_suppkey % 12 AS INTEGER) AS tag FROM lineitem) GROUP BY 1, 2""")
def tiff_compressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).cast("int").alias("tag"))
    return t.groupBy("tag", c.tiff_compression(F.col("tag")).alias("compression")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '|' || CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR) || '|' || coalesce(CAST(nullif(o_custkey, 1) AS VARCHAR), '') AS record FROM orders""")
def path_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested claims as fixed-width text, by dotted paths."""
    claim = F.struct(F.struct(F.col("o_orderdate").cast("date").alias("received")).alias("dates"), F.struct(F.col("o_totalprice").cast("decimal(18,2)").alias("total")).alias("money"), F.nullif(F.col("o_custkey"), F.lit(1)).alias("member"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", claim.alias("claim"))
    shown = [c.path_text(F.col(f"claim.{path}"), rows.select(f"claim.{path}").dtypes[0][1]) for path in ("dates.received", "money.total", "member")]
    return rows.select("o_orderkey", F.concat_ws("|", *shown).alias("record"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events) SELECT event_type, event_id FROM r ORDER BY turn, event_type LIMIT 50""")
def balanced_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty events, as even over the types as they allow."""
    return governance.balanced_top(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", [F.col("event_id")], 50)


@query("""WITH v AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'patient_last' WHEN 1 THEN 'patient_sex' WHEN 2 THEN 'insured_addr1' WHEN 3 THEN 'insured_zip' ELSE 'provider_city' END AS field, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN CAST(10000 + c_custkey AS VARCHAR) ELSE '12 Oak' END AS value FROM customer)
SELECT field, count(*) AS n, count(*) FILTER (WHERE CASE field WHEN 'patient_last' THEN NOT regexp_matches(value, '[0-9]') AND regexp_full_match(value, '[A-Za-z][A-Za-z''.-]*') WHEN 'patient_sex' THEN upper(value) IN ('M', 'F', 'U') WHEN 'insured_addr1' THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
 WHEN 'insured_zip' THEN regexp_full_match(value, '[0-9]{5}') ELSE regexp_full_match(value, '[A-Za-z .''-]{2,}') END) AS valid FROM v GROUP BY 1""")
def valid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values may stand in their field."""
    key = F.col("c_custkey")
    field = F.when(key % 5 == 0, "patient_last").when(key % 5 == 1, "patient_sex").when(key % 5 == 2, "insured_addr1").when(key % 5 == 3, "insured_zip").otherwise("provider_city")
    value = F.when(key % 3 == 0, F.col("c_mktsegment")).when(key % 3 == 1, (key + 10000).cast("string")).otherwise("12 Oak")
    return table(spark, sf_dir, "customer").groupBy(field.alias("field")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c.candidate_valid(field, value)).alias("valid"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def evidence_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written in the five formats of claim evidence, and in one that isn't."""
    key, day = F.col("o_orderkey") % 6, F.col("o_orderdate")
    written = F.when(key == 0, F.date_format(day, "yyyy-MM-dd"))
    for k, form in enumerate(("MM/dd/yyyy", "MMddyyyy", "MMddyy", "M/d/yy", "dd.MM.yyyy"), 1):
        written = F.when(key == k, F.date_format(day, form)).otherwise(written)
    return table(spark, sf_dir, "orders").select("o_orderkey", c.evidence_date(written).alias("day"))


@query("""SELECT CASE event_type WHEN 'purchase' THEN 'C3' WHEN 'login' THEN 'C2' WHEN 'view' THEN 'C0' ELSE 'C1' END AS level, count(*) AS n FROM events GROUP BY 1""")
def criticality_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = spark.createDataFrame([("purchase", "C3"), ("login", "C2"), ("view", "C0")], "event_type string, level string")
    return policies.with_criticality(table(spark, sf_dir, "events").select("event_type"), levels, "event_type", "level").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'STP' ELSE 'HITL' END AS d FROM orders), r AS (SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') AND max(l_discount) < 0.09 THEN 'STP' ELSE 'HITL' END AS d FROM lineitem GROUP BY 1)
SELECT o_orderkey AS claim, CASE WHEN r.d IS NULL THEN 'NOT_RECOMPUTED' WHEN s.d <> r.d THEN 'PARITY_FAILED' WHEN s.d = 'STP' THEN 'RELEASED' ELSE 'NOT_STP' END AS outcome FROM s LEFT JOIN r ON o_orderkey = l_orderkey""")
def claims_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored decisions against those made anew from the fields."""
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), F.when(F.col("o_orderstatus") == "F", "STP").otherwise("HITL").alias("decision"))
    anew = F.when(F.bool_and(F.col("l_linestatus") == "F") & (F.max("l_discount") < 0.09), "STP").otherwise("HITL")
    recomputed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim")).agg(anew.alias("decision"))
    return policies.finalisation_gate(stored, recomputed, "claim", "decision")


@query("""WITH e AS (SELECT (event_id % 101) / 100.0 AS p, CAST(event_id % 3 = 0 AS INTEGER) AS y FROM events), b AS (SELECT CASE WHEN p < 1 THEN CAST(floor(p * 10) AS INTEGER) END AS bin, count(*) AS k, avg(p) AS p, avg(y) AS y FROM e GROUP BY 1)
SELECT CAST(sum(k) AS BIGINT) AS n, round(sum(CASE WHEN bin IS NOT NULL THEN k * abs(y - p) END) / sum(k), 9) AS error FROM b""")
def binned_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(((F.col("event_id") % 101) / 100.0).alias("p"), (F.col("event_id") % 3 == 0).cast("int").alias("y"))
    return metrics.binned_error(e, "p", "y").select("n", F.round("error", 9).alias("error"))
