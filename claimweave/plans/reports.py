"""Reports over whole runs: gates, funnels, coverage, deltas, agreement, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import metrics
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""WITH d AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_suppkey % 9 <> 0) AS decided, bool_and(1 - l_discount >= 0.94) AS stp, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost FROM lineitem GROUP BY 1)
SELECT l_orderkey % 10 AS batch, count(*) AS documents, CASE WHEN bool_and(decided = n) THEN CAST(count(*) FILTER (WHERE stp) AS DOUBLE) / count(*) END AS stp_rate, CAST(round_even(sum(cost), 0) AS DOUBLE) / count(*) AS cost_per_document FROM d GROUP BY 1""")
def stp_rate_if_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a batch, which are only known once every document has a decision, and rounded cost per document."""
    n = F.count(F.lit(1))
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n.alias("n"), F.count_if(F.col("l_suppkey") % 9 != 0).alias("decided"), F.bool_and(1 - F.col("l_discount") >= 0.94).alias("stp"), F.sum(numbers.cents(F.col("l_extendedprice"))).alias("cost"))
    complete = F.bool_and(F.col("decided") == F.col("n"))
    return d.groupBy((F.col("l_orderkey") % 10).alias("batch")).agg(n.alias("documents"), F.when(complete, numbers.rate(F.count_if("stp"), n)).alias("stp_rate"), (F.bround(F.sum("cost"), 0).cast("double") / n).alias("cost_per_document"))


@query("""WITH r AS (SELECT source, lang AS truth, CASE WHEN doc_id % 8 = 0 THEN 'en' ELSE lang END AS predicted FROM documents), l AS (SELECT source, truth AS label FROM r UNION SELECT source, predicted FROM r),
c AS (SELECT l.source, l.label, count(*) FILTER (WHERE truth = label AND predicted = label) AS tp, count(*) FILTER (WHERE truth = label) AS t, count(*) FILTER (WHERE predicted = label) AS p FROM l JOIN r ON r.source = l.source GROUP BY 1, 2)
SELECT source, count(*) AS n_classes, round(avg(CASE WHEN t + p > 0 THEN 2.0 * tp / (t + p) END), 9) AS macro_f1, min(CASE WHEN t > 0 THEN CAST(tp AS DOUBLE) / t END) AS worst_recall FROM c GROUP BY 1""")
def macro_f1_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 and the worst recall of each source, over the classes that occur there."""
    r = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("truth"), F.when(F.col("doc_id") % 8 == 0, "en").otherwise(F.col("lang")).alias("predicted"))
    hit = F.col("truth") == F.col("predicted")
    both = F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    long = r.select("source", hit.alias("hit"), F.explode(both).alias("x")).select("source", "hit", "x.*")
    c = long.groupBy("source", "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.count_if((F.col("t") == 1) & F.col("hit")).alias("tp"))
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n_classes"), F.round(F.avg(2.0 * F.col("tp") / (F.col("t") + F.col("p"))), 9).alias("macro_f1"), F.min(numbers.defined_rate(F.col("tp"), F.col("t"))).alias("worst_recall"))


@query("""WITH r AS (SELECT d.doc_id, lang AS family, quality = 1 AS verified FROM documents d JOIN labels USING (doc_id)), f AS (SELECT DISTINCT family FROM r), v AS (SELECT doc_id, family, verified, CASE WHEN doc_id % 6 = 0 THEN 'en' ELSE family END AS claimed FROM r)
SELECT f.family, count(*) FILTER (WHERE claimed = f.family AND v.family = f.family AND verified) AS tp, count(*) FILTER (WHERE claimed = f.family AND v.family <> f.family AND verified) AS fp, count(*) FILTER (WHERE v.family = f.family AND NOT (claimed = f.family AND verified)) AS fn FROM v, f GROUP BY 1""")
def verification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and false verifications of each family against the rest."""
    v = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("family"), (F.col("quality") == 1).alias("ok"), F.when(F.col("doc_id") % 6 == 0, "en").otherwise(F.col("lang")).alias("claimed"))
    same = F.col("claimed") == F.col("family")
    own = v.groupBy("family").agg(F.count_if(same & F.col("ok")).alias("tp"), F.count_if(~(same & F.col("ok"))).alias("fn"))
    other = v.groupBy(F.col("claimed").alias("family")).agg(F.count_if(~same & F.col("ok")).alias("fp"))
    return own.join(other, "family", "left").select("family", "tp", F.coalesce("fp", F.lit(0)).alias("fp"), "fn")


@query("""WITH f AS (SELECT l_returnflag, l_linestatus, l_shipdate FROM lineitem WHERE l_discount >= 0.08), p AS (SELECT 'flag' AS dimension, l_returnflag AS value FROM f UNION ALL SELECT 'status', l_linestatus FROM f UNION ALL SELECT 'year', CAST(year(l_shipdate) AS VARCHAR) FROM f)
SELECT dimension, value, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY dimension) AS share FROM p GROUP BY 1, 2""")
def pareto_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error counts along several dimensions at once."""
    f = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.08")
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in (("flag", F.col("l_returnflag")), ("status", F.col("l_linestatus")), ("year", F.year("l_shipdate")))))
    counts = f.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("dimension")))


@query("""WITH c AS (SELECT event_type AS engine, regexp_replace(props, '[^0-9]', '', 'g') AS expected, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN regexp_replace(props, '[^0-9]', '', 'g') || '1' ELSE regexp_replace(props, '[^0-9]', '', 'g') END AS found FROM events)
SELECT engine, count(*) AS n, CAST(count(*) FILTER (WHERE found = expected) AS DOUBLE) / count(*) AS exact, CAST(sum(levenshtein(expected, found)) AS DOUBLE) / sum(length(expected)) AS corpus_cer FROM c GROUP BY 1""")
def corpus_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors over all characters of an engine, not the mean of its fields' rates."""
    expected = F.regexp_replace("props", "[^0-9]", "")
    c = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), expected.alias("e"), F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 7 == 0, F.concat(expected, F.lit("1"))).otherwise(expected).alias("f"))
    n = F.count(F.lit(1))
    return c.groupBy("engine").agg(n.alias("n"), numbers.rate(F.count_if(F.col("e") == F.col("f")), n).alias("exact"), (F.sum(F.levenshtein("e", "f")).cast("double") / F.sum(F.length("e"))).alias("corpus_cer"))


@query("""WITH r AS (SELECT event_type AS family, value / 60 AS confidence FROM events), b AS (SELECT *, CASE WHEN confidence >= 0.5 AND confidence < 0.6 THEN '0.50-0.60' WHEN confidence >= 0.6 AND confidence < 0.7 THEN '0.60-0.70' WHEN confidence >= 0.7 AND confidence < 0.8 THEN '0.70-0.80' WHEN confidence >= 0.8 THEN '0.80-' END AS bucket FROM r)
SELECT bucket, count(*) AS n, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM b WHERE bucket IS NOT NULL GROUP BY 1""")
def calibration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open confidence bins from one half on; empty bins are left out."""
    c = F.col("value") / 60
    bucket = F.when((c >= 0.5) & (c < 0.6), "0.50-0.60").when((c >= 0.6) & (c < 0.7), "0.60-0.70").when((c >= 0.7) & (c < 0.8), "0.70-0.80").when(c >= 0.8, "0.80-")
    return table(spark, sf_dir, "events").withColumn("bucket", bucket).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("families"))


@query("""WITH p AS (SELECT unnest(['quality', 'toxic']) AS dimension, unnest([quality, toxic]) AS a, unnest([CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END, CASE WHEN doc_id % 9 = 0 THEN 1 - toxic ELSE toxic END]) AS b FROM labels)
SELECT dimension, count(*) AS n, CAST(count(*) FILTER (WHERE a = b) AS DOUBLE) / count(*) AS raw, count(*) FILTER (WHERE a <> b) AS disagreements FROM p GROUP BY 1""")
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw agreement of two annotators in each dimension."""
    key = F.col("doc_id")
    dims = F.array(
        F.struct(F.lit("quality").alias("dimension"), F.col("quality").alias("a"), F.when(key % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("b")),
        F.struct(F.lit("toxic").alias("dimension"), F.col("toxic").alias("a"), F.when(key % 9 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("b")),
    )
    p = table(spark, sf_dir, "labels").select(F.explode(dims).alias("d")).select("d.*")
    n, same = F.count(F.lit(1)), F.col("a") == F.col("b")
    return p.groupBy("dimension").agg(n.alias("n"), numbers.rate(F.count_if(same), n).alias("raw"), F.count_if(~same).alias("disagreements"))


_BUNDLES = {"discount+tax": (["discount", "tax"], 2.0), "discount+tax+units": (["discount", "tax", "units"], 3.0), "units": (["units"], 1.0)}


@query("""WITH b AS (SELECT l_orderkey, list_filter(list_distinct(list(CASE WHEN l_discount >= 0.1 THEN 'discount' END) || list(CASE WHEN l_tax >= 0.08 THEN 'tax' END) || list(CASE WHEN l_quantity >= 50 THEN 'units' END)), lambda x: x IS NOT NULL) AS s FROM lineitem GROUP BY 1),
u AS (SELECT * FROM (VALUES ('discount+tax', ['discount', 'tax'], 2.0), ('discount+tax+units', ['discount', 'tax', 'units'], 3.0), ('units', ['units'], 1.0)) t(bundle, fields, effort))
SELECT bundle, count(*) FILTER (WHERE len(s) > 0 AND len(list_filter(s, lambda x: NOT list_contains(fields, x))) = 0) AS unlocked, CAST(count(*) FILTER (WHERE len(s) > 0 AND len(list_filter(s, lambda x: NOT list_contains(fields, x))) = 0) AS DOUBLE) / CAST(any_value(effort) AS DOUBLE) AS per_effort FROM b, u GROUP BY bundle""")
def blocker_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that work on a bundle of fields would unlock, by effort."""
    found = [("discount", F.col("l_discount") >= 0.1), ("tax", F.col("l_tax") >= 0.08), ("units", F.col("l_quantity") >= 50)]
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.bool_or(c).alias(n) for n, c in found)).select(F.array_compact(F.array(*(F.when(F.col(n), n) for n, _ in found))).alias("s")).filter("size(s) > 0")
    tests = F.array(*(F.struct(F.lit(name).alias("bundle"), (F.size(F.array_except("s", F.array(*map(F.lit, fs)))) == 0).alias("ok"), F.lit(effort).alias("effort")) for name, (fs, effort) in sorted(_BUNDLES.items())))
    out = b.select(F.explode(tests).alias("t")).groupBy("t.bundle").agg(F.count_if("t.ok").alias("unlocked"), F.max("t.effort").alias("effort"))
    return out.select("bundle", "unlocked", (F.col("unlocked") / F.col("effort")).alias("per_effort"))


@query("""WITH m AS (SELECT event_type AS metric, avg(CAST(value AS DECIMAL(18,6))) FILTER (WHERE user_id % 2 = 0) AS base, avg(CAST(value AS DECIMAL(18,6))) FILTER (WHERE user_id % 2 = 1) AS cand, count(*) AS n FROM events GROUP BY 1)
SELECT metric, round(CAST(cand AS DOUBLE) - CAST(base AS DOUBLE), 6) AS delta, CASE WHEN n < 100 THEN 'NEEDS_MORE_DATA' WHEN cand > base THEN 'PROMOTE' ELSE 'REJECT' END AS verdict FROM m""")
def experiment_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, odd = F.col("value").cast("decimal(18,6)"), F.col("user_id") % 2
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg(F.when(odd == 0, v)).alias("base"), F.avg(F.when(odd == 1, v)).alias("cand"), F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("n") < 100, "NEEDS_MORE_DATA").when(F.col("cand") > F.col("base"), "PROMOTE").otherwise("REJECT")
    return m.select("metric", F.round(F.col("cand").cast("double") - F.col("base").cast("double"), 6).alias("delta"), verdict.alias("verdict"))


@query("""WITH s AS (SELECT user_id, list_distinct(list(event_type)) AS have FROM events WHERE value > 8 GROUP BY 1), g AS (SELECT user_id, list_filter(['view', 'click', 'login', 'purchase', 'search'], lambda x: NOT list_contains(have, x))[1] AS gap FROM s)
SELECT coalesce(gap, 'COMPLETE') AS first_gap, count(*) AS n FROM g GROUP BY 1""")
def stage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage, in order, that each page hasn't reached."""
    s = table(spark, sf_dir, "events").filter("value > 8").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    gap = F.get(F.array_except(F.array(*map(F.lit, ("view", "click", "login", "purchase", "search"))), F.col("have")), F.lit(0))
    return s.groupBy(F.coalesce(gap, F.lit("COMPLETE")).alias("first_gap")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT source) < 15 AS thin FROM documents GROUP BY 1""")
def representation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))
    return g.withColumn("thin", F.col("sources") < 15)


@query("""WITH o AS (SELECT conv_id AS document, role AS label, count(*) AS c FROM conversations GROUP BY 1, 2), d AS (SELECT document, sum(c) AS n, sum(c * (c - 1)) / 2 AS same FROM o GROUP BY 1)
SELECT document, CAST(n * (n - 1) / 2 AS BIGINT) AS pairs, CASE WHEN n > 1 THEN CAST(same AS DOUBLE) / CAST(n * (n - 1) / 2 AS DOUBLE) ELSE 0.0 END AS agreement FROM d""")
def pairwise_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a document's label pairs that are equal, from counts: no pairs are made."""
    o = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("document"), "role").agg(F.count(F.lit(1)).alias("c"))
    d = o.groupBy("document").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("twice"))
    pairs = F.expr("n * (n - 1) div 2")
    return d.select("document", pairs.alias("pairs"), F.when(F.col("n") > 1, F.col("twice") / 2 / pairs).otherwise(0.0).alias("agreement"))


@query("""SELECT engine, field, count(*) AS n, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS accuracy, CAST(sum(ms) AS DOUBLE) / count(*) AS mean_ms FROM (SELECT l_suppkey % 5 AS engine, l_returnflag AS field, l_discount < 0.08 AS ok, CAST(l_quantity AS BIGINT) AS ms FROM lineitem) GROUP BY 1, 2""")
def engine_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("engine"), F.col("l_returnflag").alias("field")).agg(
        n.alias("n"), numbers.rate(F.count_if(F.col("l_discount") < 0.08), n).alias("accuracy"), (F.sum(F.col("l_quantity").cast("bigint")).cast("double") / n).alias("mean_ms")
    )


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_discount < 0.08) AS ok, count(*) FILTER (WHERE l_suppkey % 9 <> 0) AS answered, count(*) FILTER (WHERE l_tax < 0.05) AS accepted, count(*) FILTER (WHERE l_discount < 0.08 AND l_suppkey % 9 <> 0) AS ok_answered, count(*) FILTER (WHERE l_discount < 0.08 AND l_tax < 0.05) AS ok_accepted FROM lineitem)
SELECT CAST(ok AS DOUBLE) / n AS of_all, CAST(ok_answered AS DOUBLE) / answered AS of_answered, CAST(ok_accepted AS DOUBLE) / accepted AS of_accepted FROM c""")
def accuracy_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One accuracy over three denominators."""
    ok, answered, accepted = F.col("l_discount") < 0.08, F.col("l_suppkey") % 9 != 0, F.col("l_tax") < 0.05
    return table(spark, sf_dir, "lineitem").agg(
        numbers.rate(F.count_if(ok), F.count(F.lit(1))).alias("of_all"), numbers.rate(F.count_if(ok & answered), F.count_if(answered)).alias("of_answered"), numbers.rate(F.count_if(ok & accepted), F.count_if(accepted)).alias("of_accepted")
    )


@query("""WITH f AS (SELECT o_orderkey AS claim_id, CASE WHEN o_totalprice < 0 THEN 'NEGATIVE' END AS a, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 400000 THEN 'OPEN_TOO_LARGE' END AS b, CASE WHEN o_custkey % 100 = 0 THEN 'UNKNOWN_MEMBER' END AS c FROM orders), v AS (SELECT claim_id, unnest([a, b, c]) AS violation FROM f)
SELECT violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY 1""")
def policy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of claims that were let through, by name."""
    named = F.array_compact(F.array(F.when(F.col("o_totalprice") < 0, "NEGATIVE"), F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 400000), "OPEN_TOO_LARGE"), F.when(F.col("o_custkey") % 100 == 0, "UNKNOWN_MEMBER")))
    return table(spark, sf_dir, "orders").select(F.explode(named).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN doc_id % 7 = 0 THEN 'unlinked' END], lambda x: x IS NOT NULL) AS cats FROM documents)
SELECT coalesce(list_filter(['unlinked', 'short', 'foreign'], lambda x: list_contains(cats, x))[1], 'none') AS cause, count(*) AS n FROM c GROUP BY 1""")
def primary_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several categories of a row reduced to the first by priority."""
    cats = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "foreign"), F.when(F.col("doc_id") % 7 == 0, "unlinked")))
    first = F.get(F.array_intersect(F.array(*map(F.lit, ("unlinked", "short", "foreign"))), cats), F.lit(0))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(first, F.lit("none")).alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n, CAST(count(*) FILTER (WHERE quality = 1 - toxic) AS DOUBLE) / count(*) AS agreement FROM labels""")
def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return metrics.cohen_kappa(pairs, "a", "b").select("n", "agreement")
