"""Contracts and manifests: snapshot checks, reachability, occurrences, workflow states, cross-field rules, JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, numbers
from ..operators import decisions as d
from ..operators import evidence
from ..sources.files import canonical_json
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


def binary_columns(schema: T.DataType, path: str = "") -> list[str]:
    """Paths of binary fields anywhere in a schema: payloads may not have any."""
    if isinstance(schema, T.BinaryType):
        return [path]
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in binary_columns(f.dataType, f"{path}.{f.name}".lstrip("."))]
    if isinstance(schema, T.ArrayType):
        return binary_columns(schema.elementType, f"{path}[]")
    if isinstance(schema, T.MapType):
        return binary_columns(schema.keyType, f"{path}.key") + binary_columns(schema.valueType, f"{path}.value")
    return []


@query("""WITH r AS (SELECT CASE WHEN c_custkey % 100 = 0 THEN NULL ELSE c_custkey % 1450 END AS id, DATE '1995-01-01' + CAST(c_custkey % 50 AS INTEGER) AS since, DATE '1995-01-01' + CAST(c_custkey % 37 + 10 AS INTEGER) AS until FROM customer), n AS (SELECT id, count(*) AS n FROM r WHERE id IS NOT NULL GROUP BY 1)
SELECT 'MISSING_ID' AS violation, count(*) AS n FROM r WHERE id IS NULL UNION ALL SELECT 'DUPLICATE_ID', count(*) FROM n WHERE n > 1 UNION ALL SELECT 'INVERTED_VALIDITY', count(*) FROM r WHERE since > until""")
def snapshot_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes a reference snapshot unusable: missing or repeated ids, validity that ends before it begins."""
    key, start = F.col("c_custkey"), F.lit("1995-01-01").cast("date")
    r = table(spark, sf_dir, "customer").select(F.when(key % 100 != 0, key % 1450).alias("id"), F.date_add(start, (key % 50).cast("int")).alias("since"), F.date_add(start, (key % 37 + 10).cast("int")).alias("until"))
    ids = r.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("since") > F.col("until")).alias("inverted"))
    sums = ids.agg(
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("MISSING_ID"), F.count_if(F.col("id").isNotNull() & (F.col("n") > 1)).alias("DUPLICATE_ID"), F.coalesce(F.sum("inverted"), F.lit(0)).alias("INVERTED_VALIDITY")
    )
    return sums.unpivot([], ["MISSING_ID", "DUPLICATE_ID", "INVERTED_VALIDITY"], "violation", "n")


@query("""WITH f AS (SELECT source AS field, coalesce(list_sort(list_distinct(list(lang) FILTER (WHERE n_chars > 3000))), []) AS have FROM documents GROUP BY 1), o AS (SELECT unnest([['en', 'fr', 'de', 'es'], ['en', 'es']]) AS opt)
SELECT field, CASE WHEN field = 'src3' THEN 'UNCONFIGURED' WHEN bool_or(len(list_filter(opt, lambda x: NOT list_contains(have, x))) = 0) THEN 'REACHABLE' ELSE 'UNREACHABLE' END AS status FROM f, o GROUP BY 1""")
def policy_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose policy some alternative of the evidence there is can meet."""
    f = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("field")).agg(F.collect_set(F.when(F.col("n_chars") > 3000, F.col("lang"))).alias("have"))
    options = evidence.alternatives([["en", "fr", "de", "es"], ["en", "es"]])
    return f.select("field", d.ladder((F.col("field") == "src3", "UNCONFIGURED"), (evidence.satisfied(options, F.col("have")), "REACHABLE"), otherwise="UNREACHABLE").alias("status"))


@query("""WITH g AS (SELECT l_orderkey AS claim_id, l_linestatus AS field, list_sort(list(l_returnflag)) AS vs FROM lineitem GROUP BY 1, 2)
SELECT claim_id, string_agg(field || '=' || array_to_string(vs, '|'), ';' ORDER BY field) AS occurrences FROM g GROUP BY 1""")
def field_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of each field of a claim, one or many."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id"), F.col("l_linestatus").alias("field")).agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), "|").alias("vs"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "field", "vs")))
    return g.groupBy("claim_id").agg(F.array_join(pairs, ";").alias("occurrences"))


_STATES = ("login", "view", "search", "click", "purchase")


def _ordinal(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, _STATES)), state)


@query("""WITH s AS (SELECT user_id, max(list_position(['login', 'view', 'search', 'click', 'purchase'], event_type)) AS k, count(*) AS attempts FROM events GROUP BY 1) SELECT user_id, ['login', 'view', 'search', 'click', 'purchase'][k] AS state, attempts > 60 AS failed FROM s WHERE k > 0""")
def workflow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each workflow came in the order of states, and whether it used up its attempts."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(_ordinal(F.col("event_type"))).alias("k"), F.count(F.lit(1)).alias("attempts")).filter("k > 0")
    return s.select("user_id", F.element_at(F.array(*map(F.lit, _STATES)), F.col("k").cast("int")).alias("state"), (F.col("attempts") > 60).alias("failed"))


@query("""WITH x AS (SELECT o_orderkey AS claim_id, DATE '1930-01-01' + CAST(o_custkey * 17 % 25000 AS INTEGER) AS birth, CAST(o_orderdate AS DATE) AS service FROM orders)
SELECT claim_id, coalesce(birth <= service AND date_diff('day', birth, service) / 365.25 <= 60, FALSE) AS plausible, service <= DATE '1998-01-01' AS past, coalesce(date_diff('day', service, DATE '1998-06-30') BETWEEN 0 AND 365, FALSE) AS timely FROM x""")
def cross_field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Birth against service date, service against today's stand-in and the filing window."""
    birth, service = F.date_add(F.lit("1930-01-01").cast("date"), (F.col("o_custkey") * 17 % 25000).cast("int")), F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"), dates.plausible_age(birth, service, 60.0).alias("plausible"), dates.not_after(service, F.lit("1998-01-01").cast("date")).alias("past"),
        dates.within_filing_window(service, F.lit("1998-06-30").cast("date")).alias("timely"),
    )


@query("""WITH a AS (SELECT user_id AS page, max(value) FILTER (WHERE event_type = 'click') AS observed, avg(CAST(value AS DECIMAL(18,6))) FILTER (WHERE event_type = 'view') AS family FROM events GROUP BY 1)
SELECT page, CASE WHEN observed IS NOT NULL AND observed > 15 THEN 'OBSERVED' WHEN family IS NOT NULL THEN 'FAMILY' ELSE 'TEMPLATE' END AS basis, round(CASE WHEN observed IS NOT NULL AND observed > 15 THEN observed + 12 WHEN family IS NOT NULL THEN CAST(family AS DOUBLE) + 10 ELSE 20 END, 6) AS x0 FROM a""")
def anchored_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a field's region is: off its observed anchor, else where the family has it, else the template."""
    kind = lambda k, v: F.when(F.col("event_type") == k, v)
    a = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page")).agg(F.max(kind("click", F.col("value"))).alias("observed"), F.avg(kind("view", F.col("value").cast("decimal(18,6)"))).alias("family"))
    seen, known = F.coalesce(F.col("observed") > 15, F.lit(False)), F.col("family").isNotNull()
    x0 = F.when(seen, F.col("observed") + 12).when(known, F.col("family").cast("double") + 10).otherwise(F.lit(20.0))
    return a.select("page", d.ladder((seen, "OBSERVED"), (known, "FAMILY"), otherwise="TEMPLATE").alias("basis"), F.round(x0, 6).alias("x0"))


@query("""WITH e AS (SELECT event_type AS action, value / 60 AS gain, user_id % 7 / 10.0 AS cost, event_id % 900 AS latency, event_id FROM events), u AS (SELECT *, round(gain / greatest(CAST(cost AS DOUBLE) + CAST(latency AS DOUBLE) / 1000, 0.001), 9) AS utility FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY utility DESC, event_id) AS k FROM u)
SELECT action, event_id, utility FROM r WHERE k <= 5""")
def evidence_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five opportunities of each action with most gain for cost and waiting: a top-k report."""
    cost, latency = (F.col("user_id") % 7 / 10.0).cast("double"), (F.col("event_id") % 900).cast("double")
    u = table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), "event_id", F.round(F.col("value") / 60 / F.greatest(cost + latency / 1000, F.lit(0.001)), 9).alias("utility"))
    return u.withColumn("k", F.row_number().over(Window.partitionBy("action").orderBy(F.col("utility").desc(), "event_id"))).filter("k <= 5").drop("k")


@query("""SELECT o_orderkey AS claim_id, '{"cents":' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) || ',"claim_id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS document FROM orders""")
def canonical_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as compact JSON with sorted keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), (numbers.cents(F.col("o_totalprice")) * 100).cast("bigint").alias("cents"), F.col("o_orderstatus").alias("status"))
    return o.select("claim_id", canonical_json("claim_id", "status", "cents").alias("document"))


@query("""SELECT l_orderkey AS claim_id, string_agg(DISTINCT l_linenumber || '@' || l_suppkey, ',' ORDER BY l_linenumber || '@' || l_suppkey) AS evidence, count(*) AS n FROM lineitem GROUP BY 1""")
def evidence_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each claim's values were read."""
    place = F.concat_ws("@", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.array_join(F.array_sort(F.collect_set(place)), ",").alias("evidence"), F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT source FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 1)""")
def prohibited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed source groups that are on the prohibited list; a run may have none."""
    barred = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return table(spark, sf_dir, "documents").select("source").distinct().join(barred, "source", "left_semi")


@query("""WITH r AS (SELECT o_orderkey AS claim_id, CASE o_orderkey % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'amount' ELSE 'code' END AS field, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR) ELSE lower(o_orderpriority) END AS raw FROM orders)
SELECT claim_id, field, CASE field WHEN 'date' THEN concat_ws('|', CASE WHEN CAST(substr(raw, 1, 2) AS INTEGER) <= 12 AND try_strptime(raw, '%m/%d/%Y') IS NOT NULL THEN strftime(try_strptime(raw, '%m/%d/%Y'), '%Y-%m-%d') END, strftime(strptime(raw, '%d/%m/%Y'), '%Y-%m-%d'))
  WHEN 'amount' THEN raw || '.00|' || CAST(CAST(raw AS DECIMAL(20,0)) / 100 AS DECIMAL(18,2)) ELSE upper(raw) END AS alternatives FROM r""")
def value_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways a raw value may be read: month or day first, cents written or implied."""
    key = F.col("o_orderkey") % 3
    field = F.when(key == 0, "date").when(key == 1, "amount").otherwise("code")
    cents = (numbers.cents(F.col("o_totalprice")) * 100).cast("bigint")
    raw = F.when(key == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(key == 1, cents.cast("string")).otherwise(F.lower("o_orderpriority"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), field.alias("field"), raw.alias("raw"))
    month_first, day_first = dates.parse_date(F.col("raw")), F.to_date(F.try_to_timestamp("raw", F.lit("dd/MM/yyyy")))
    amounts = F.array(F.concat("raw", F.lit(".00")), (F.col("raw").try_cast("decimal(20,0)") / 100).cast("decimal(18,2)").cast("string"))
    found = F.when(F.col("field") == "date", F.array(month_first.cast("string"), day_first.cast("string"))).when(F.col("field") == "amount", amounts).otherwise(F.array(F.upper("raw")))
    return r.select("claim_id", "field", F.array_join(F.array_compact(found), "|").alias("alternatives"))
