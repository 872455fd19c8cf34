"""Reference data: match policies, validity, lineage, review resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as d
from ..operators import governance, tables
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""WITH m AS (SELECT o_orderkey, c_custkey IS NOT NULL AS known, c_nationkey = o_custkey % 25 AS zip_ok, o_orderkey % 3 <> 0 AS dob_ok, o_orderkey % 4 <> 0 AS name_ok, o_orderkey % 29 = 0 AS contradicted FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey AS claim_id, CASE WHEN NOT known THEN 'NOT_FOUND' WHEN contradicted THEN 'CONTRADICTION' WHEN dob_ok THEN 'VERIFIED_ID_DOB' WHEN dob_ok AND name_ok AND zip_ok THEN 'VERIFIED_DEMOGRAPHICS' ELSE 'REVIEW' END AS decision FROM m""")
def member_match_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member decisions: contradictions first, then id with birth date, then demographics."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    m = table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    key, dob = F.col("o_orderkey"), F.col("o_orderkey") % 3 != 0
    decision = d.ladder(
        (F.col("c_custkey").isNull(), "NOT_FOUND"), (key % 29 == 0, "CONTRADICTION"), (dob, "VERIFIED_ID_DOB"), (dob & (key % 4 != 0) & (F.col("c_nationkey") == F.col("o_custkey") % 25), "VERIFIED_DEMOGRAPHICS"), otherwise="REVIEW"
    )
    return m.select(key.alias("claim_id"), decision.alias("decision"))


@query("""WITH v AS (SELECT c_custkey, DATE '1992-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS since, DATE '1992-01-01' + CAST(c_custkey % 1000 + 900 AS INTEGER) AS until FROM customer)
SELECT o_orderkey AS claim_id, CASE WHEN c_custkey IS NULL THEN 'UNKNOWN' WHEN CAST(o_orderdate AS DATE) < since THEN 'BEFORE' WHEN CAST(o_orderdate AS DATE) >= until THEN 'AFTER' ELSE 'COVERED' END AS coverage FROM orders LEFT JOIN v ON c_custkey = o_custkey""")
def coverage_at_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a member was covered on the claim's date."""
    day = F.to_date("o_orderdate")
    start = F.lit("1992-01-01").cast("date")
    v = table(spark, sf_dir, "customer").select("c_custkey", F.date_add(start, (F.col("c_custkey") % 1000).cast("int")).alias("since"), F.date_add(start, (F.col("c_custkey") % 1000 + 900).cast("int")).alias("until"))
    joined = table(spark, sf_dir, "orders").join(v, F.col("c_custkey") == F.col("o_custkey"), "left")
    state = d.ladder((F.col("c_custkey").isNull(), "UNKNOWN"), (day < F.col("since"), "BEFORE"), (day >= F.col("until"), "AFTER"), otherwise="COVERED")
    return joined.select(F.col("o_orderkey").alias("claim_id"), state.alias("coverage"))


@query("""WITH l AS (SELECT p_partkey, list_distinct([substr(p_brand, 7, 1), substr(p_type, 1, 1), CAST(p_size % 3 AS VARCHAR)]) AS lineage FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN list_contains(lineage, '1') THEN 'FORBIDDEN:1' END, CASE WHEN list_contains(lineage, 'E') THEN 'FORBIDDEN:E' END, CASE WHEN len(lineage) < 3 THEN 'NOT_INDEPENDENT' END) AS violations FROM l""")
def lineage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins that a reference may not have, and those that aren't independent."""
    lineage = F.array_distinct(F.array(F.substring("p_brand", 7, 1), F.substring("p_type", 1, 1), (F.col("p_size") % 3).cast("string")))
    found = d.reasons((F.array_contains(lineage, "1"), "FORBIDDEN:1"), (F.array_contains(lineage, "E"), "FORBIDDEN:E"), (F.size(lineage) < 3, "NOT_INDEPENDENT"))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("violations"))


@query("""WITH r AS (SELECT l_orderkey AS asset, l_suppkey AS reviewer, min(l_returnflag) AS label FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY reviewer) AS turn FROM r), p AS (SELECT asset, max(CASE WHEN turn = 1 THEN label END) AS a, max(CASE WHEN turn = 2 THEN label END) AS b, max(CASE WHEN turn = 3 THEN label END) AS c FROM k WHERE turn <= 3 GROUP BY 1)
SELECT asset, CASE WHEN b IS NULL THEN 'SINGLE' WHEN a = b THEN 'AGREED' WHEN c IS NULL THEN 'DISPUTED' ELSE 'ADJUDICATED' END AS state, CASE WHEN b IS NULL THEN NULL WHEN a = b THEN a ELSE c END AS label FROM p""")
def review_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second review of an asset; a third one decides where they differ."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("asset"), F.col("l_suppkey").alias("reviewer")).agg(F.min("l_returnflag").alias("label"))
    p = r.groupBy("asset").agg(F.transform(F.array_sort(F.collect_list(F.struct("reviewer", "label"))), lambda x: x["label"]).alias("ls"))
    a, b, c = (F.get("ls", F.lit(k)) for k in range(3))
    return p.select("asset", F.when(b.isNull(), "SINGLE").when(a == b, "AGREED").when(c.isNull(), "DISPUTED").otherwise("ADJUDICATED").alias("state"), F.when(b.isNull(), None).when(a == b, a).otherwise(c).alias("label"))


@query("""WITH e AS (SELECT doc_id, 'source:' || source || ':' || lang AS identity, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'y' END AS family FROM documents UNION ALL SELECT doc_id, 'length:' || n_chars, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'y' END FROM documents)
SELECT identity, count(DISTINCT family) AS splits, count(*) AS n FROM e GROUP BY 1 HAVING count(DISTINCT family) > 1""")
def lineage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage that assets of different families share, by any of several identities."""
    side = F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y")
    ids = F.array(F.concat(F.lit("source:"), "source", F.lit(":"), "lang"), F.concat(F.lit("length:"), F.col("n_chars").cast("string")))
    rows = table(spark, sf_dir, "documents").select(side.alias("family"), F.explode(ids).alias("identity"))
    return governance.leaking_identities(rows, "identity", "family")


@query("""WITH t AS (SELECT o_orderkey AS task, CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'DONE' END AS status, o_orderkey % 3 AS version FROM orders), q AS (SELECT o_orderkey AS task, 1 AS expected, 'ann' AS who FROM orders UNION ALL SELECT o_orderkey, 1, 'bob' FROM orders WHERE o_custkey % 2 = 0)
SELECT q.task, who, CASE WHEN status = 'OPEN' AND version = expected AND who = 'ann' THEN 'CLAIMED' ELSE 'CONFLICT' END AS outcome FROM q JOIN t USING (task)""")
def review_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers claim tasks at a version: one wins, the others conflict."""
    o = table(spark, sf_dir, "orders")
    tasks = o.select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("DONE").alias("status"), (F.col("o_orderkey") % 3).alias("version"))
    who = F.array_compact(F.array(F.lit("ann"), F.when(F.col("o_custkey") % 2 == 0, "bob")))
    asked = o.select(F.col("o_orderkey").alias("task"), F.lit(1).cast("long").alias("expected_version"), F.explode(who).alias("who"))
    return tables.compare_and_set(tasks, asked, "task")[1]


@query("""WITH e AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-08-02' - INTERVAL 1000 DAY) SELECT l_orderkey AS document, count(*) AS pages FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM e) GROUP BY 1""")
def retention_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left below documents that retention keeps."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document"), F.col("o_orderdate").cast("timestamp").alias("received"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"))
    _, left, _ = tables.retention_sweep(orders, lines, "document", "received", F.lit("1998-08-02").cast("timestamp"), 1000)
    return left.groupBy("document").agg(F.count(F.lit(1)).alias("pages"))
