"""Governance: splits, samples, duplicates, leakage, ledgers and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import governance as g
from ..operators.graph import connected_components
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

SEED = "claims-2024"
SHARES = [("train", 70), ("validation", 15), ("holdout", 15)]
_BUCKET = "CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT) % 100"
_SPLIT = f"CASE WHEN {_BUCKET} < 70 THEN 'train' WHEN {_BUCKET} < 85 THEN 'validation' ELSE 'holdout' END"
_MOD = "list_reduce(list_transform(string_split(sha256({x}), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, d: (a * 16 + d) % 100, 0)"


@query(f"SELECT doc_id, {_SPLIT.format(x=f"'{SEED}:' || source || '/' || doc_id")} AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by seeded hash into 70, 15 and 15 percent."""
    key = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", hashing.split_name(key, SEED, SHARES).alias("split"))


@query(f"SELECT doc_id, CASE WHEN {_MOD.format(x="CAST(doc_id AS VARCHAR)")} < 30 THEN 'HOLDOUT' ELSE 'DEVELOPMENT' END AS split FROM documents")
def full_digest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole 256-bit digest modulo 100."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(hashing.whole_digest_bucket(F.col("doc_id").cast("string")) < 30, "HOLDOUT").otherwise("DEVELOPMENT").alias("split"))


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('{SEED}:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= greatest(1, least(round_even(n * 0.7, 0), n - 1)) THEN 'DEVELOPMENT' ELSE 'HOLDOUT' END AS split FROM r""")
def ranked_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.ranked_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED, 0.7)


@query(f"""WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), t AS (SELECT *, sum(size) OVER () AS total FROM s), f AS (SELECT *, (size * 133) // total AS fl, (size * 133) % total AS rest FROM t),
q AS (SELECT source, least(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= 133 - sum(fl) OVER () THEN 1 ELSE 0 END, size) AS quota FROM f),
r AS (SELECT d.doc_id, d.source, quota, row_number() OVER (PARTITION BY d.source ORDER BY sha256('{SEED}|' || d.doc_id), d.doc_id) AS k FROM documents d JOIN q USING (source))
SELECT doc_id, source FROM r WHERE k <= quota""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """133 documents over all sources in proportion: the size of the sample is the feature."""
    return g.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 133, SEED)


_QUOTAS = {"AO": 400, "NF": 900, "RF": 100, "NO": 0, "AF": 1_000_000}


@query(f"""WITH q AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {n})" for k, n in _QUOTAS.items() if n)}) t(kind, target)), c AS (SELECT CAST(l_orderkey AS VARCHAR) AS package, l_returnflag || l_linestatus AS kind, count(*) AS n, sha256('["quota","' || l_orderkey || '"]') AS d FROM lineitem JOIN q ON kind = l_returnflag || l_linestatus GROUP BY ALL),
r AS (SELECT c.*, target, sum(n) OVER (PARTITION BY kind ORDER BY d, package) - n AS before FROM c JOIN q USING (kind))
SELECT DISTINCT package FROM r WHERE before < target""")
def quota_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole orders until each kind of line has its number; one kind never gets there."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("package"), F.concat("l_returnflag", "l_linestatus").alias("kind"))
    return g.quota_sample(rows, "package", "kind", _QUOTAS, "quota")


@query("""WITH r AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS turn FROM documents) SELECT doc_id, source, turn FROM r ORDER BY turn, source LIMIT 50""")
def round_robin_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents that a review round-robin over sources shows first."""
    return g.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", [F.col("n_chars").desc(), F.col("doc_id")], 50).select("doc_id", "source", "turn")


@query(f"""WITH d AS (SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h, lang FROM documents), a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM d WHERE lang = 'de' OR h / 4294967295.0 < 0.2)
SELECT doc_id, 'reviewer' || (k % 5) AS first_reviewer, 'reviewer' || ((k + 1) % 5) AS second_reviewer FROM a""")
def double_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for two blind reviews: a hard class always, of the others a fifth by hash; reviewers in turn."""
    h = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    chosen = table(spark, sf_dir, "documents").filter((F.col("lang") == "de") | (h / F.lit(4294967295.0) < 0.2)).select("doc_id")
    # turn in the order of ids from counts per range of ids: no global sort in one task
    span = 4096
    block = F.floor(F.col("doc_id") / span)
    counts = chosen.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("b", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    k = F.row_number().over(Window.partitionBy("b").orderBy("doc_id")) - 1 + F.col("before")
    ranked = chosen.withColumn("b", block).join(before, "b").withColumn("k", k)
    name = lambda x: F.concat(F.lit("reviewer"), F.pmod(x, F.lit(5)).cast("string"))
    return ranked.select("doc_id", name(F.col("k")).alias("first_reviewer"), name(F.col("k") + 1).alias("second_reviewer"))


@query("""SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return d.filter("n > 1")


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line, 'train' AS split, doc_id AS id FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT unnest(string_split(text, chr(10))), 'holdout', doc_id FROM documents WHERE doc_id % 3 = 0)
SELECT md5(line) AS identity, count(DISTINCT split) AS splits, count(*) AS n FROM l WHERE length(line) > 40 GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def holdout_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lines that occur in training and in held-out documents."""
    lines = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "holdout").otherwise("train").alias("split"), F.explode(F.split("text", "\n")).alias("line"))
    return g.leaking_identities(lines.filter(F.length("line") > 40).select(F.md5("line").alias("identity"), "split"), "identity", "split")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT md5(text) AS a, 'src:' || source || ':' || n_chars AS b FROM documents), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS reach FROM two UNION SELECT r.node, two.b FROM r JOIN two ON r.reach = two.a), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT doc_id, component, {_SPLIT.format(x=f"'{SEED}:' || component")} AS split FROM documents JOIN c ON node = md5(text)""")
def component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a text, or source and length, stay on one side of the split."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("a"), F.concat_ws(":", F.lit("src"), "source", F.col("n_chars").cast("string")).alias("b"))
    labels = connected_components(d.select("a", "b"), "a", "b")
    return d.join(labels, F.col("a") == F.col("node")).select("doc_id", "component", hashing.split_name(F.col("component"), SEED, SHARES).alias("split"))


_CHAIN_PAYLOAD = "event_id || ':' || event_type"


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, {_CHAIN_PAYLOAD} AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
c AS (SELECT user_id, event_id, k, sha256('GENESIS|' || p) AS h FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, sha256(c.h || '|' || o.p) FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1)
SELECT user_id, max(k) AS n, arg_max(h, k) AS head FROM c GROUP BY user_id""")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger for each user: its length and the digest of its last event."""
    e = table(spark, sf_dir, "events")
    links = g.chain(e, "user_id", "event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type"))
    return links.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("hash", "event_id").alias("head"))


@query("""SELECT user_id, count(*) AS n, CAST(CASE WHEN user_id % 10 = 0 AND max(event_id) > min(event_id) THEN 2 WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS broken FROM events GROUP BY user_id""")
def hash_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers checked after the first digest of every tenth was tampered with: that event and the next one fail."""
    e = table(spark, sf_dir, "events")
    payload = F.concat_ws(":", F.col("event_id").cast("string"), "event_type")
    links = g.chain(e, "user_id", "event_id", payload).join(e.select("user_id", "event_id", "event_type"), ["user_id", "event_id"])
    first = F.col("previous") == "GENESIS"
    tampered = links.withColumn("hash", F.when(first & (F.col("user_id") % 10 == 0), F.reverse("hash")).otherwise(F.col("hash")))
    return g.verify_chain(tampered, "user_id", "event_id", payload)


@query("""SELECT user_id, event_id, 'uid-' || user_id AS subject, sha256(user_id || '|' || event_id || '|' || event_type) AS prediction_id, substr(sha256(event_type || '|1|' || value), 1, 24) AS candidate_id FROM (SELECT user_id, event_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value FROM events)""")
def deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value").cast("decimal(18,2)").cast("string"))
    return e.select(
        "user_id", "event_id", F.concat(F.lit("uid-"), F.col("user_id").cast("string")).alias("subject"), hashing.digest_of(F.col("user_id"), F.col("event_id"), F.col("event_type")).alias("prediction_id"),
        F.substring(hashing.digest_of(F.col("event_type"), F.lit(1), F.col("v")), 1, 24).alias("candidate_id"),
    )


@query()
def identity_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed digests (HMAC) and name-based ids (UUID version 5) of members."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", hashing.hmac_sha256(F.col("c_name"), "review-key").alias("fingerprint"), hashing.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.col("c_name")).alias("uuid"))


@query("""SELECT o_orderkey AS task, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate + INTERVAL 30 DAY ASC NULLS LAST, o_totalprice DESC, o_orderkey) AS INTEGER) AS place, o_orderpriority AS queue FROM orders""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each queue's tasks by due date, then by value."""
    due = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    w = Window.partitionBy("o_orderpriority").orderBy(due.asc_nulls_last(), F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.row_number().over(w).alias("place"), F.col("o_orderpriority").alias("queue"))


@query("""WITH p AS (SELECT conv_id, role, text AS opening, max(turn) AS last_turn FROM conversations GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY last_turn DESC, opening) AS k FROM p)
SELECT conv_id, role, opening, last_turn FROM r WHERE k <= 3""")
def recent_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest different turns of each role: a top-k report."""
    p = table(spark, sf_dir, "conversations").groupBy("conv_id", "role", F.col("text").alias("opening")).agg(F.max("turn").alias("last_turn"))
    k = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.col("last_turn").desc(), "opening"))
    return p.withColumn("k", k).filter("k <= 3").drop("k")


@query("""WITH l AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER w AS before, lag(ts) OVER w AS before_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, concat_ws('+', CASE WHEN before IS NULL THEN 'PACKAGE_START' END, CASE WHEN before <> event_type THEN 'CLASS_CHANGE' END, CASE WHEN ts - before_ts > INTERVAL 1 HOUR THEN 'GAP' END) AS reasons FROM l""")
def document_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one document ends and the next begins in a package's pages, and why."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before, gap = F.lag("event_type").over(w), F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    reasons = F.concat_ws("+", F.when(before.isNull(), "PACKAGE_START"), F.when(before != F.col("event_type"), "CLASS_CHANGE"), F.when(gap > 3_600_000_000, "GAP"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", reasons.alias("reasons"))


@query("""WITH RECURSIVE t AS (SELECT 'N' || n_nationkey AS node, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'R' || r_regionkey, 'ROOT' FROM region), a AS (SELECT node, parent AS ancestor, 1 AS depth FROM t UNION ALL SELECT a.node, t.parent, a.depth + 1 FROM a JOIN t ON a.ancestor = t.node)
SELECT node, ancestor, depth FROM a""")
def taxonomy_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every node, by a recursive query."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent")).union(
        r.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), F.lit("ROOT"))
    )
    return spark.sql(
        "WITH RECURSIVE a (node, ancestor, depth) AS (SELECT node, parent, 1 FROM {tree} UNION ALL SELECT a.node, t.parent, a.depth + 1 FROM a JOIN {tree} t ON a.ancestor = t.node) SELECT node, ancestor, depth FROM a", tree=tree
    )
