"""Field and claim decisions, routes, governance of labels and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import decisions as d
from ..operators import joins
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""SELECT l_orderkey AS claim_id, l_linenumber AS line, CASE WHEN l_quantity IS NULL THEN 'HITL_MISSING' WHEN l_suppkey % 9 = 0 AND l_discount > 0.08 THEN 'HITL_CONTRADICTION' WHEN l_tax < 0.01 THEN 'REFERENCE_CONFIRMED' WHEN 1 - l_discount >= 0.98 THEN 'AUTO_ACCEPT' WHEN 1 - l_discount >= 0.94 THEN 'ACCEPT_WITH_CORROBORATION' ELSE 'HITL_LOW_CONFIDENCE' END AS decision, count(*) AS n FROM lineitem GROUP BY ALL""")
def field_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's place on the decision ladder."""
    decision = d.field_decision(F.col("l_quantity").isNull(), (F.col("l_suppkey") % 9 == 0) & (F.col("l_discount") > 0.08), F.col("l_tax") < 0.01, 1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line"), decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT l_orderkey AS claim_id, count(*) AS n, min(1 - l_discount) AS weakest, avg(l_quantity) AS mean_quantity, max(l_tax) AS tax FROM lineitem GROUP BY 1)
SELECT claim_id, least(weakest, 1 - tax, least(mean_quantity / 50, 1.0)) AS quality, concat_ws(',', CASE WHEN n < 2 THEN 'INCOMPLETE' END, CASE WHEN weakest < 0.92 THEN 'LOW_CONFIDENCE' END, CASE WHEN tax > 0.07 THEN 'HIGH_TAX' END) AS reasons FROM q""")
def safe_stp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of a claim as its weakest part, and what keeps it from safe processing."""
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.count(F.lit(1)).alias("n"), F.min(1 - F.col("l_discount")).alias("weakest"), F.avg("l_quantity").alias("mean_quantity"), F.max("l_tax").alias("tax"))
    quality = F.least(F.col("weakest"), 1 - F.col("tax"), F.least(F.col("mean_quantity") / 50, F.lit(1.0)))
    return q.select("claim_id", quality.alias("quality"), d.reasons((F.col("n") < 2, "INCOMPLETE"), (F.col("weakest") < 0.92, "LOW_CONFIDENCE"), (F.col("tax") > 0.07, "HIGH_TAX")).alias("reasons"))


@query("""WITH a AS (SELECT user_id, list_distinct(list(event_type)) AS tried FROM events GROUP BY 1) SELECT user_id, list_filter(['login', 'view', 'click', 'purchase', 'local', 'cloud'], lambda m: NOT list_contains(tried, m))[1] AS next FROM a""")
def model_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next model to try, after those that were."""
    tried = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tried"))
    return tried.select("user_id", d.next_model(["login", "view", "click", "purchase", "local", "cloud"], F.col("tried")).alias("next"))


_POLICIES = [("src1", "en", 0.9), ("*", "en", 0.8), ("src2", "*", 0.7), ("*", "de", 0.6)]


@query("""WITH p AS (SELECT * FROM (VALUES ('src1', 'en', 0.9), ('*', 'en', 0.8), ('src2', '*', 0.7), ('*', 'de', 0.6)) t(f, n, v))
SELECT doc_id, CAST(coalesce((SELECT v FROM p WHERE f = source AND n = lang), (SELECT v FROM p WHERE f = '*' AND n = lang), (SELECT v FROM p WHERE f = source AND n = '*'), 0.5) AS DOUBLE) AS threshold FROM documents""")
def policy_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by the most specific policy."""
    policies = spark.createDataFrame(_POLICIES, "source string, lang string, threshold double")
    return d.with_precedence(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), policies, "source", "lang", "threshold", F.lit(0.5)).select("doc_id", "threshold")


@query("""WITH p AS (SELECT a.l_orderkey AS claim_id, a.l_suppkey AS x, b.l_suppkey AS y, CASE WHEN a.l_partkey = b.l_partkey THEN 'CORRELATED' WHEN CAST(a.l_returnflag = b.l_returnflag AS INTEGER) + CAST(a.l_linestatus = b.l_linestatus AS INTEGER) = 0 THEN 'INDEPENDENT' ELSE 'PARTIAL' END AS relation
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey)
SELECT claim_id, count(*) AS pairs, count(*) FILTER (WHERE relation = 'CORRELATED') AS correlated, count(*) FILTER (WHERE relation = 'INDEPENDENT') > 0 AS corroborated FROM p GROUP BY 1""")
def evidence_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a claim's candidates by what they have in common; a claim's candidates are few."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    a, b = lines.alias("a"), lines.alias("b")
    side = lambda s: {"part": F.col(f"{s}.l_partkey"), "flag": F.col(f"{s}.l_returnflag"), "status": F.col(f"{s}.l_linestatus")}
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") < F.col("b.l_suppkey")))
    related = pairs.select(F.col("a.l_orderkey").alias("claim_id"), d.dependency(side("a"), side("b"), ["part"]).alias("relation"))
    return related.groupBy("claim_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("relation") == "CORRELATED").alias("correlated"), F.bool_or(F.col("relation") == "INDEPENDENT").alias("corroborated"))


_ROUTES = [("local", ["E1", "E2"], 1.0), ("reference", ["E3"], 2.5), ("human", [], 9.0)]


@query("""WITH f AS (SELECT l_orderkey AS claim_id, list_distinct(list(CASE l_returnflag WHEN 'A' THEN 'E1' WHEN 'N' THEN 'E2' ELSE 'E4' END)) AS a FROM lineitem GROUP BY 1),
r AS (SELECT claim_id, CAST(NOT list_contains(a, 'E1') AS INTEGER) + CAST(NOT list_contains(a, 'E2') AS INTEGER) AS m, a FROM f)
SELECT claim_id, CASE WHEN m = 0 THEN 'human' WHEN m * 1.0 <= 2.5 THEN 'local' ELSE 'reference' END AS naive, CAST(CASE WHEN m = 0 THEN 0.0 ELSE least(m * 1.0, 2.5) END AS DOUBLE) AS cost FROM r""")
def evidence_gap_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest way to complete each claim's evidence; nothing missing costs nothing."""
    kind = F.when(F.col("l_returnflag") == "A", "E1").when(F.col("l_returnflag") == "N", "E2").otherwise("E4")
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_set(kind).alias("a"))
    best = d.cheapest_route([r for r in _ROUTES if r[0] != "human"], F.col("a"))
    return f.select("claim_id", F.when(best["cost"] == 0, "human").otherwise(best["route"]).alias("naive"), best["cost"].alias("cost"))


@query("""WITH l AS (SELECT doc_id, quality, toxic, doc_id % 4 AS reviewer, doc_id % 3 AS approver, doc_id % 10 = 0 AS held FROM labels)
SELECT doc_id, concat_ws(',', CASE WHEN reviewer = approver THEN 'SELF_APPROVAL' END, CASE WHEN toxic = 1 AND quality = 1 THEN 'CONTRADICTORY' END, CASE WHEN held THEN 'HOLDOUT_MEMBER' END) AS reasons, NOT (reviewer = approver OR (toxic = 1 AND quality = 1) OR held) AS eligible FROM l""")
def trusted_label_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a label may not be used for training."""
    key = F.col("doc_id")
    found = d.label_refusals(key % 4, key % 3, (F.col("toxic") == 1) & (F.col("quality") == 1), key % 10 == 0)
    return table(spark, sf_dir, "labels").select("doc_id", found.alias("reasons")).withColumn("eligible", F.col("reasons") == "")


@query("""WITH l AS (SELECT doc_id, quality AS p, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 1 - toxic END AS c, doc_id % 5 <> 0 AS pv, doc_id % 3 <> 0 AS cv, doc_id % 7 <> 0 AS own, doc_id % 11 <> 0 AS safe FROM labels)
SELECT doc_id, CASE WHEN NOT safe THEN 'HITL' WHEN c IS NULL OR c = p THEN 'KEEP_PRIMARY' WHEN cv AND NOT pv AND own THEN 'USE_CHALLENGER' ELSE 'HITL' END AS action,
 CASE WHEN c IS NULL THEN 'NO_CANDIDATE' WHEN safe AND c = p THEN 'AGREE' ELSE 'DISAGREE' END AS agreement,
 CASE WHEN NOT safe THEN 'LOCALIZATION_NOT_CROP_SAFE' WHEN c IS NULL THEN 'CHALLENGER_EMPTY' WHEN c = p AND own THEN 'INDEPENDENT_ENGINE_AGREEMENT' WHEN c = p THEN 'AGREEMENT_NOT_INDEPENDENT' WHEN pv AND cv THEN 'INDEPENDENT_VALID_CANDIDATES_DISAGREE'
  WHEN cv AND own THEN 'VALID_INDEPENDENT_CHALLENGER_REPLACES_INVALID_PRIMARY' ELSE 'CHALLENGER_ACCEPTANCE_GATES_FAILED' END AS reason FROM l""")
def challenger_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    verdict = d.challenger_verdict(F.col("quality"), F.when(key % 6 != 0, 1 - F.col("toxic")), key % 5 != 0, key % 3 != 0, key % 7 != 0, key % 11 != 0)
    return table(spark, sf_dir, "labels").select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


@query("""WITH s AS (SELECT page_id, CASE WHEN contains(html, '<form') THEN 0.9 ELSE 0.1 END AS form, CASE WHEN length(html) < 1200 THEN 0.8 ELSE 0.2 END AS short, CASE WHEN contains(html, '<b>') THEN 0.6 ELSE 0.0 END AS bold FROM pages)
SELECT page_id, CAST(greatest(form, short, bold) AS DOUBLE) AS risk, concat_ws(',', CASE WHEN form >= 0.5 THEN 'FORM' END, CASE WHEN short >= 0.5 THEN 'SHORT' END, CASE WHEN bold >= 0.5 THEN 'BOLD' END) AS reasons FROM s""")
def wrong_crop_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk as the largest of several signals, and the signals that are over the threshold."""
    html = F.col("html")
    signals = {"FORM": F.when(F.contains(html, F.lit("<form")), 0.9).otherwise(0.1), "SHORT": F.when(F.length(html) < 1200, 0.8).otherwise(0.2), "BOLD": F.when(F.contains(html, F.lit("<b>")), 0.6).otherwise(0.0)}
    return table(spark, sf_dir, "pages").select("page_id", d.largest_risk(signals).alias("r")).select("page_id", "r.risk", "r.reasons")


@query("""WITH t AS (SELECT page_id, CAST(contains(html, '<nav') AS INTEGER) + CAST(contains(html, '<h1>') AS INTEGER) + CAST(contains(html, '<footer') AS INTEGER) + CAST(contains(html, '<table') AS INTEGER) AS n, contains(html, '<article>') AS essential FROM pages)
SELECT page_id, n / 4.0 AS score, CASE WHEN n >= 3 AND essential THEN 'VERIFIED' WHEN n >= 2 THEN 'AMBIGUOUS' ELSE 'REJECTED' END AS status FROM t""")
def form_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traits of a standard form that a page has."""
    has = lambda s: F.contains("html", F.lit(s))
    status = d.form_status([has(s) for s in ("<nav", "<h1>", "<footer", "<table")], has("<article>"), 3, 2)
    return table(spark, sf_dir, "pages").select("page_id", status.alias("s")).select("page_id", "s.score", "s.status")


@query("""WITH w AS (SELECT source, lang, n_chars // 100 AS value, count(DISTINCT doc_id) AS docs, bool_or(n_chars > 500) AS anchored FROM documents GROUP BY 1, 2, 3)
SELECT d.doc_id FROM documents d JOIN w ON w.source = d.source AND w.lang = d.lang AND w.value = d.n_chars // 100 WHERE docs >= 3 AND anchored""")
def population_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that enough documents of a population share, one of them anchored, hold for all of these."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.floor(F.col("n_chars") / 100).alias("value"), "n_chars")
    return d.with_consensus(docs, ["source", "lang"], "value", "doc_id", F.col("n_chars") > 500).select("doc_id")


@query("""WITH o AS (SELECT lang AS truth, CASE WHEN doc_id % 8 = 0 THEN 'en' WHEN doc_id % 13 = 0 THEN NULL ELSE lang END AS route, n_chars FROM documents),
k AS (SELECT *, CASE WHEN route IS NULL THEN 5 WHEN route = truth THEN 0 WHEN n_chars > 2000 THEN 100 ELSE 40 END AS risk FROM o)
SELECT truth, count(*) AS n, CAST(count(*) FILTER (WHERE route = truth) AS DOUBLE) / count(*) AS accuracy, CAST(count(*) FILTER (WHERE route IS NULL) AS DOUBLE) / count(*) AS abstained, CAST(sum(risk) AS DOUBLE) / count(*) AS mean_risk FROM k GROUP BY 1""")
def routing_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, abstention and mean risk of routes by true class."""
    key = F.col("doc_id")
    o = table(spark, sf_dir, "documents").select(F.col("lang").alias("truth"), F.when(key % 8 == 0, "en").when(key % 13 == 0, None).otherwise(F.col("lang")).alias("route"), "n_chars")
    return d.routing_summary(o, "truth", "route", F.when(F.col("n_chars") > 2000, 100).otherwise(40))


@query("""WITH s AS (SELECT o_orderpriority AS segment, count(*) AS claims, count(*) FILTER (WHERE o_orderstatus = 'P') AS review, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice < 20000) AS false_accepts, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1)
SELECT segment, claims, CAST(review AS DOUBLE) / claims AS review_rate, false_accepts, p95, concat_ws(',', CASE WHEN NOT claims >= 100 THEN 'ENOUGH' END, CASE WHEN NOT CAST(review AS DOUBLE) / claims <= 0.3 THEN 'REVIEW' END, CASE WHEN NOT false_accepts = 0 THEN 'FALSE_ACCEPTS' END) AS failed FROM s""")
def shadow_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a shadow run against the gates for going live."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "segment")
    return d.segment_gates(o, "segment", F.col("o_orderstatus") == "P", (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 20000), "o_totalprice")


@query("""SELECT conv_id, bool_or(role = 'system') AS has_system, count(DISTINCT role) AS roles, CASE WHEN bool_and(role = 'user') THEN 'SINGLE' WHEN bool_or(role = 'user') AND bool_or(role = 'assistant') THEN 'DIALOGUE' ELSE 'OTHER' END AS bundle FROM conversations GROUP BY 1""")
def bundle_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle's class from the set of its pages' classes."""
    is_ = lambda r: F.col("role") == r
    kind = F.when(F.bool_and(is_("user")), "SINGLE").when(F.bool_or(is_("user")) & F.bool_or(is_("assistant")), "DIALOGUE").otherwise("OTHER")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(is_("system")).alias("has_system"), F.countDistinct("role").alias("roles"), kind.alias("bundle"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, 1 - l_discount AS c, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY 1 - l_discount DESC, l_suppkey, l_partkey, l_extendedprice) AS k FROM lineitem)
SELECT l_orderkey AS claim_id, count(*) AS n_fields, string_agg(l_linenumber || '=' || l_returnflag, ';' ORDER BY l_linenumber) AS fields FROM l WHERE k = 1 GROUP BY 1""")
def claim_from_long_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims put together from long field rows, the best candidate of each field."""
    lines = table(spark, sf_dir, "lineitem").withColumn("c", 1 - F.col("l_discount"))
    order = [F.col("c"), -F.col("l_suppkey"), -F.col("l_partkey"), -F.col("l_extendedprice")]
    best = joins.last_of_each(lines, ["l_orderkey", "l_linenumber"], order)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.concat(F.col("l_linenumber").cast("string"), F.lit("="), "l_returnflag").alias("v"))))
    return best.groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.count(F.lit(1)).alias("n_fields"), F.array_join(F.transform(pairs, lambda p: p["v"]), ";").alias("fields"))


@query("""SELECT c_custkey, string_split(c_name, '#')[1] AS first_part, upper(string_split(c_name, '#')[-1]) AS last_name FROM customer""")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members' names taken apart."""
    parsed = text.person_name(F.regexp_replace("c_name", "#", " "))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(F.split("c_name", "#"), F.lit(0)).alias("first_part"), parsed["last"].alias("last_name"))


@query("""WITH f AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS fields FROM events GROUP BY 1), s AS (SELECT * FROM (VALUES ('shop', ['click', 'purchase', 'view']), ('account', ['login', 'logout', 'signup']), ('search', ['search', 'view'])) t(schema, needs)),
o AS (SELECT user_id, schema, CAST(len(list_intersect(fields, needs)) AS DOUBLE) / len(needs) AS overlap FROM f, s), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY overlap DESC, schema DESC) AS k FROM o)
SELECT user_id, CASE WHEN overlap >= 0.45 THEN schema ELSE 'UNKNOWN' END AS schema, overlap FROM r WHERE k = 1""")
def schema_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema whose fields are best covered; ties by name, the last first."""
    known = {"shop": ["click", "purchase", "view"], "account": ["login", "logout", "signup"], "search": ["search", "view"]}
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("fields"))
    return f.select("user_id", d.best_schema(F.col("fields"), known).alias("s")).select("user_id", "s.schema", "s.overlap")


@query("""WITH p AS (SELECT o_orderkey % 500 AS document, CAST(o_custkey % 7 AS INTEGER) AS page, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2) SELECT document, page, n, CAST(row_number() OVER (PARTITION BY document ORDER BY n, page) AS INTEGER) AS place FROM p""")
def hitl_page_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in review, those with least to do first."""
    pages = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").groupBy((F.col("o_orderkey") % 500).alias("document"), (F.col("o_custkey") % 7).cast("int").alias("page")).agg(F.count(F.lit(1)).alias("n"))
    return pages.withColumn("place", F.row_number().over(Window.partitionBy("document").orderBy("n", "page")))


@query("""WITH t AS (SELECT event_id AS a, user_id AS field, event_type AS value FROM events WHERE value > 5), c AS (SELECT field, count(DISTINCT value) AS v FROM t GROUP BY 1), r AS (SELECT t.*, row_number() OVER (PARTITION BY t.field, value ORDER BY a) AS k, v FROM t JOIN c USING (field))
SELECT field, value, a AS first_event FROM r WHERE v <= 5 AND k = 1""")
def training_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example of each value of fields whose labels don't conflict."""
    t = table(spark, sf_dir, "events").filter("value > 5").select(F.col("event_id").alias("a"), F.col("user_id").alias("field"), F.col("event_type").alias("value"))
    good = t.groupBy("field").agg(F.countDistinct("value").alias("v")).filter("v <= 5")
    return t.join(good, "field", "left_semi").groupBy("field", "value").agg(F.min("a").alias("first_event"))
