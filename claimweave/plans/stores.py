"""Record files, frozen releases and closures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import releases
from ..sources import ledger, recordfiles
from ..sources.staging import shared_folder
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

_SPEC = [("HD", "order_id", 3, 10, 13), ("HD", "status", 13, 1, 13), ("LN", "part_id", 3, 8, 16), ("LN", "total_units", 11, 6, 16)]


@query("""WITH h AS (SELECT o_orderkey AS k, 'HD' AS record, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS order_id, o_orderstatus AS status FROM orders), l AS (SELECT l_orderkey AS k, lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS part_id, lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 6, ' ') AS units FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT lpad(CAST(k AS VARCHAR), 10, '0') AS claim, field, raw, trim(raw) AS normalized, CASE WHEN field = 'total_units' THEN 'critical' ELSE 'standard' END AS criticality, count(*) AS n FROM (SELECT k, 'order_id' AS field, order_id AS raw FROM h UNION ALL SELECT k, 'status', status FROM h UNION ALL SELECT k, 'part_id', part_id FROM l UNION ALL SELECT k, 'total_units', units FROM l) GROUP BY ALL""")
def truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines written as fixed-width text, and every field read back as the truth of its claim."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    head = orders.select(F.col("o_orderkey").alias("k"), F.lit(0).alias("n"), F.concat(F.lit("HD"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), "o_orderstatus").alias("line"))
    body = lines.filter("l_orderkey IS NOT NULL").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("n"), F.concat(F.lit("LN"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lpad(F.col("l_quantity").cast("bigint").cast("string"), 6, " ")).alias("line"))
    # as if joined to the orders, but lines are moved once: a line stands as often as its key has orders before it
    orders_before = F.count_if(F.col("n") == 0).over(Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = head.unionByName(body).repartition("k").withColumn("times", F.when(F.col("n") == 0, 1).otherwise(orders_before.cast("int")))
    path = f"{shared_folder(spark)}/claimweave/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/records"
    rows.select(F.explode(F.array_repeat("line", F.col("times"))).alias("line")).write.text(path)
    groups = recordfiles.record_groups(recordfiles.text_lines(spark, path), F.col("line").startswith("HD"))
    spec = spark.createDataFrame(_SPEC, "record string, field string, start int, length int, record_length int")
    _, _, start, length, record_length = _SPEC[0]  # a claim is named by its head
    claims = groups.withColumn("claim", F.when(F.length("head") == record_length, F.substring("head", start, length))).filter("claim IS NOT NULL")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number, as fields are more rows than the lines that are dealt
    labels = recordfiles.truth_labels(claims.repartition(tasks, "claim"), spec, F.substring("line", 1, 2), ("total",), ("claim",))
    return labels.groupBy("claim", "field", "raw", "normalized", "criticality").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT source AS release, doc_id, sha256(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents), m AS (SELECT release, doc_id, CASE WHEN doc_id % 211 = 0 THEN sha256('as it was') ELSE digest END AS digest FROM f WHERE doc_id % 97 <> 0 UNION ALL SELECT release, -doc_id - 1, digest FROM f WHERE doc_id % 301 = 0),
d AS (SELECT coalesce(f.release, m.release) AS release, coalesce(f.doc_id, m.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'MISSING' WHEN m.doc_id IS NULL THEN 'ADDED' WHEN f.digest = m.digest THEN 'SAME' ELSE 'CHANGED' END AS status FROM f FULL JOIN m ON f.release = m.release AND f.doc_id = m.doc_id)
SELECT release, CASE WHEN release = 'src3' THEN 'NOT_FROZEN' WHEN count(*) FILTER (WHERE status IN ('MISSING', 'CHANGED')) > 0 THEN 'BROKEN' ELSE 'PASS' END AS decision, count(*) FILTER (WHERE status IN ('MISSING', 'CHANGED')) AS broken, min(CASE WHEN status IN ('MISSING', 'CHANGED') THEN status || ':' || release || '/' || doc_id END) AS first FROM d GROUP BY 1""")
def release_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as the files of a release, held against a manifest in which some have changed, gone or come since."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    files = docs.select("source", "doc_id", path.alias("path"), releases.content_digest(F.coalesce("text", F.lit("")).cast("binary"), F.lit(True)).alias("digest"))
    kept = files.filter("doc_id % 97 <> 0").select("path", F.when(F.col("doc_id") % 211 == 0, F.sha2(F.lit("as it was"), 256)).otherwise(F.col("digest")).alias("digest"))
    gone = files.filter("doc_id % 301 = 0").select(F.concat_ws("/", "source", (-F.col("doc_id") - 1).cast("string")).alias("path"), "digest")
    differences = releases.release_differences(files, kept.unionByName(gone)).withColumn("release", F.substring_index("path", "/", 1))
    return releases.integrity_gate(differences, "release", F.when(F.col("release") == "src3", "DRAFT").otherwise("FROZEN"))


@query("""WITH t AS (SELECT DISTINCT user_id AS task, CASE WHEN user_id % 9 = 0 THEN 'VERIFIED_BY_HUMAN' ELSE 'OPEN' END AS status FROM events), c AS (SELECT user_id AS task, event_id AS version, CASE WHEN event_id % 4 = 0 THEN event_type || event_id ELSE event_type END AS value, 'r' || event_id % 5 AS reviewer, event_id % 4 <> 0 AS ok FROM events WHERE event_type IN ('view', 'click')),
a AS (SELECT user_id AS task, event_id AS version, 'r' || event_id % 7 AS approver FROM events WHERE event_type = 'purchase'), g AS (SELECT task, arg_min(value, version) AS value, arg_min(reviewer, version) AS reviewer FROM c WHERE ok GROUP BY 1), b AS (SELECT task, count(*) FILTER (WHERE NOT ok) AS invalid FROM c GROUP BY 1),
r AS (SELECT t.*, CASE WHEN status = 'OPEN' THEN g.value END AS value, CASE WHEN status = 'OPEN' THEN g.reviewer END AS reviewer, coalesce(invalid, 0) AS invalid FROM t LEFT JOIN g USING (task) LEFT JOIN b USING (task)),
v AS (SELECT r.task, arg_min(approver, version) FILTER (WHERE reviewer IS NOT NULL AND approver <> reviewer) AS approver, count(*) FILTER (WHERE approver = reviewer) AS own, count(*) FILTER (WHERE reviewer IS NULL) AS early FROM a JOIN r USING (task) GROUP BY 1)
SELECT r.task, CASE WHEN value IS NULL THEN status WHEN approver IS NOT NULL THEN 'VERIFIED_BY_HUMAN' ELSE 'PENDING_SECOND_APPROVAL' END AS status, value, reviewer, approver, concat_ws(',', CASE WHEN invalid > 0 THEN 'CORRECTION_INVALID' END, CASE WHEN own > 0 THEN 'SELF_APPROVAL' END, CASE WHEN early > 0 THEN 'NOTHING_TO_APPROVE' END, CASE WHEN value IS NULL AND status <> 'OPEN' THEN 'TASK_NOT_OPEN' END) AS refusals FROM r LEFT JOIN v USING (task)""")
def verified_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks closed by a valid correction and another person's approval, and what was refused."""
    e = table(spark, sf_dir, "events")
    tasks = e.select(F.col("user_id").alias("task"), F.when(F.col("user_id") % 9 == 0, "VERIFIED_BY_HUMAN").otherwise("OPEN").alias("status")).distinct()
    person = lambda n: F.concat(F.lit("r"), (F.col("event_id") % n).cast("string"))
    value = F.when(F.col("event_id") % 4 == 0, F.concat("event_type", F.col("event_id").cast("string"))).otherwise(F.col("event_type"))
    corrections = e.filter(F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("task"), F.col("event_id").alias("version"), value.alias("value"), person(5).alias("reviewer"))
    approvals = e.filter(F.col("event_type") == "purchase").select(F.col("user_id").alias("task"), F.col("event_id").alias("version"), person(7).alias("approver"))
    return ledger.closures(tasks, corrections, approvals)
