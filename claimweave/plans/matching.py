"""Matching: reference lookups, ranking and votes, layout joins, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import joins, ranking
from ..operators.graph import connected_components
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""WITH r AS (SELECT c_custkey % 1400 AS member_id, c_nationkey, c_mktsegment FROM customer), k AS (SELECT member_id, count(*) AS n, min(c_nationkey) AS nation, min(c_mktsegment) AS segment FROM r GROUP BY 1)
SELECT o_orderkey AS claim_id, CASE WHEN n IS NULL THEN 'NO_MATCH' WHEN n > 1 THEN 'CONFLICT_NOT_UNIQUE' WHEN coalesce(CAST(o_orderkey % 25 AS INTEGER) = nation, TRUE) AND coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' END = segment, TRUE) THEN 'MATCH' ELSE 'CONFLICT' END AS outcome, coalesce(n, 0) AS matches
FROM orders LEFT JOIN k ON member_id = o_custkey""")
def unique_match_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims' members against a roster in which some numbers occur twice."""
    roster = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1400).alias("member_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("member_id"), (F.col("o_orderkey") % 25).cast("int").alias("nation"), F.when(F.col("o_orderkey") % 2 == 0, "BUILDING").alias("segment"))
    return joins.unique_match(asked, roster, "member_id", ["nation", "segment"], "claim_id")


@query("""SELECT l_orderkey AS claim_id, count(*) AS n_lines, count(*) FILTER (WHERE s_suppkey IS NULL) AS unknown, count(*) FILTER (WHERE s_acctbal < 0) AS inactive, count(DISTINCT n_name) AS n_states
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 10 <> 3 LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def provider_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers of each claim's lines: unknown, inactive, and in how many places."""
    providers = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 3").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(providers, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.groupBy(F.col("l_orderkey").alias("claim_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("s_suppkey").isNull()).alias("unknown"), F.count_if(F.col("s_acctbal") < 0).alias("inactive"), F.countDistinct("n_name").alias("n_states")
    )


@query("""WITH r AS (SELECT upper(p_brand) AS code, count(*) AS n, count(DISTINCT p_type) AS kinds FROM part WHERE p_size <= 40 GROUP BY 1)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'NO_MATCH' WHEN n > 1 AND kinds > 1 THEN 'CONFLICT_NOT_UNIQUE' ELSE 'MATCH' END AS outcome FROM part LEFT JOIN r ON code = upper(regexp_replace(p_brand, ' ', '', 'g'))""")
def code_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    known = parts.filter("p_size <= 40").groupBy(F.upper("p_brand").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("kinds"))
    asked = parts.select("p_partkey", F.upper(F.regexp_replace("p_brand", " ", "")).alias("code"))
    outcome = F.when(F.col("n").isNull(), "NO_MATCH").when((F.col("n") > 1) & (F.col("kinds") > 1), "CONFLICT_NOT_UNIQUE").otherwise("MATCH")
    return asked.join(known, "code", "left").select("p_partkey", outcome.alias("outcome"))


def _closest_names(spark: SparkSession, sf_dir: str, like: joins.Likeness) -> DataFrame:
    """Members and the reference row of their block, place and segment, whose name is most like theirs."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"), F.coalesce("c_name", F.lit("")).alias("name") if like is joins.BY_BLOCKS else F.col("c_name").alias("name"), "c_nationkey", "c_mktsegment")
    found = joins.most_similar(c.filter("member % 2 = 0"), c.filter("member % 2 = 1").withColumnRenamed("member", "reference"), ["c_nationkey", "c_mktsegment"], "name", "reference", like)
    best = ranking.top_with_margin(found, ["member"], "similarity", [F.col("reference")])
    return best.select("member", "reference", "similarity", (F.col("similarity") >= 0.92).alias("verified"))


@query("""WITH p AS (SELECT a.c_custkey AS member, b.c_custkey AS reference, 1 - CAST(levenshtein(a.c_name, b.c_name) AS DOUBLE) / greatest(length(a.c_name), length(b.c_name)) AS similarity FROM customer a JOIN customer b USING (c_nationkey, c_mktsegment) WHERE a.c_custkey % 2 = 0 AND b.c_custkey % 2 = 1)
SELECT member, reference, similarity, similarity >= 0.92 AS verified FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY similarity DESC, reference) AS k FROM p) WHERE k = 1""")
def fuzzy_reference_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar name within a member's block, by edit distance."""
    return _closest_names(spark, sf_dir, joins.BY_EDITS)


@query()
def fuzzy_reference_match_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the ratio of matching blocks, which SQL doesn't have."""
    return _closest_names(spark, sf_dir, joins.BY_BLOCKS)


@query("""WITH a AS (SELECT doc_id, md5(text) AS h, CAST(n_chars AS VARCHAR) || ':' || lang || ':' || source AS r FROM documents),
b AS (SELECT DISTINCT x.doc_id, y.doc_id AS other FROM a x JOIN a y ON x.h = y.h OR x.r = y.r), n AS (SELECT doc_id, count(DISTINCT other) AS targets FROM b GROUP BY 1)
SELECT a.doc_id, CASE WHEN targets IS NULL THEN 'NOT_FOUND' WHEN targets = 1 THEN 'MATCHED_EXACT' ELSE 'AMBIGUOUS' END AS outcome, coalesce(targets, 0) AS targets FROM a LEFT JOIN n USING (doc_id)""")
def exact_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents bound to pages by content hash or by length, language and source."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), F.concat(F.col("n_chars").cast("string"), F.lit(":"), "lang", F.lit(":"), "source").alias("r"))
    return joins.exact_binding(d, d.withColumnRenamed("doc_id", "page"), "doc_id", "page", ["h", "r"])


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.last_of_each(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""WITH cell AS (SELECT r, c, c * 20.0 AS x0, c * 20.0 + 20 AS x1, r * 0.025 AS y0, r * 0.025 + 0.02 AS y1 FROM (SELECT unnest(range(0, 3)) AS c), (SELECT unnest(range(0, 5)) AS r))
SELECT r, c, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem JOIN cell ON l_quantity >= x0 AND l_quantity < x1 AND l_discount >= y0 AND l_discount < y1 GROUP BY r, c""")
def range_join_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in table cells: points in boxes of rows and columns."""
    grid = spark.range(5).select(F.col("id").alias("r")).crossJoin(spark.range(3).select(F.col("id").alias("c")))
    cells = grid.select("r", "c", (F.col("c") * 20.0).alias("x0"), (F.col("c") * 20.0 + 20).alias("x1"), (F.col("r") * F.lit(0.025)).alias("y0"), (F.col("r") * F.lit(0.025) + F.lit(0.02)).alias("y1"))
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    return joins.in_cells(lines, cells, "l_quantity", "l_discount", 10.0).groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"), F.sum(numbers.cents(F.col("l_extendedprice"))).cast("double").alias("amount"))


@query("""WITH col AS (SELECT * FROM (VALUES ('code', 4.0), ('date', 14.0), ('units', 29.0), ('charge', 43.0)) t(name, place))
SELECT name, count(*) AS n, sum(gap) AS gaps FROM (SELECT l_orderkey, l_quantity, name, abs(l_quantity - place) AS gap, row_number() OVER (PARTITION BY id ORDER BY abs(l_quantity - place), name) AS k FROM (SELECT *, row_number() OVER () AS id FROM lineitem), col) WHERE k = 1 GROUP BY name""")
def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens assigned to the nearest column."""
    columns = spark.createDataFrame([("code", 4.0), ("date", 14.0), ("units", 29.0), ("charge", 43.0)], "name string, at double")
    return joins.nearest(table(spark, sf_dir, "lineitem").select("l_quantity"), columns, "l_quantity", "at", "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gaps"))


@query("""WITH s AS (SELECT l_orderkey, l_suppkey, l_linenumber, (1 - l_discount) * 0.6 + l_quantity / 50.0 * 0.4 AS score FROM lineitem),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_suppkey, l_linenumber))
SELECT l_orderkey AS claim_id, l_suppkey AS engine, score, score - coalesce(second, 0) AS margin, CASE WHEN score < 0.8 THEN 'BELOW_THRESHOLD' WHEN score - coalesce(second, 0) < 0.03 THEN 'AMBIGUOUS' ELSE 'SELECTED' END AS status FROM r WHERE k = 1""")
def candidate_rank_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scored candidate of a claim, and whether it is far enough ahead."""
    scored = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", ((1 - F.col("l_discount")) * 0.6 + F.col("l_quantity") / 50.0 * 0.4).alias("score"))
    best = ranking.top_with_margin(scored, ["l_orderkey"], "score", [F.col("l_suppkey"), F.col("l_linenumber")])
    status = F.when(F.col("score") < 0.8, "BELOW_THRESHOLD").when(F.col("margin") < 0.03, "AMBIGUOUS").otherwise("SELECTED")
    return best.select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("engine"), "score", "margin", status.alias("status"))


@query("""WITH g AS (SELECT l_orderkey, l_quantity AS v, count(DISTINCT l_suppkey % 4) AS families, max(1 - l_discount) AS best FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS k, lead(families) OVER w AS f2, lead(best) OVER w AS b2 FROM g WINDOW w AS (PARTITION BY l_orderkey ORDER BY families DESC, best DESC, v))
SELECT l_orderkey AS claim_id, v AS value, families, least(1.0, best + 0.04 * (families - 1)) AS confidence, CASE WHEN f2 = families AND best - b2 < 0.05 THEN 'CONFLICT' WHEN families >= 2 THEN 'ACCEPT' WHEN best >= 0.98 THEN 'ESCALATE' ELSE 'REVIEW' END AS decision FROM r WHERE k = 1""")
def evidence_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with one value are one group; groups rank by independent engine families, then confidence."""
    bit = F.call_function("shiftleft", F.lit(1), (F.col("l_suppkey") % 4).cast("int") + 3)  # remainders are -3 to 3; families as bits are counted in the one pass that finds the best
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")  # once, as few lines share a value
    groups = lines.groupBy("l_orderkey", F.col("l_quantity").alias("v")).agg(F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("long").alias("families"), F.max(1 - F.col("l_discount")).alias("best"))
    w = Window.partitionBy("l_orderkey").orderBy(F.col("families").desc(), F.col("best").desc(), "v")
    r = groups.withColumn("k", F.row_number().over(w)).withColumn("f2", F.lead("families").over(w)).withColumn("b2", F.lead("best").over(w)).filter("k = 1")
    decision = F.when((F.col("f2") == F.col("families")) & (F.col("best") - F.col("b2") < 0.05), "CONFLICT").when(F.col("families") >= 2, "ACCEPT").when(F.col("best") >= 0.98, "ESCALATE").otherwise("REVIEW")
    return r.select(F.col("l_orderkey").alias("claim_id"), F.col("v").alias("value"), "families", F.least(F.lit(1.0), F.col("best") + 0.04 * (F.col("families") - 1)).alias("confidence"), decision.alias("decision"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, max(0.35 * (1 - l_discount) + 0.25 * (l_quantity / 50.0) + 0.40 * (1 - l_tax)) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS s2 FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber))
SELECT l_orderkey AS document, l_linenumber AS page, s AS score, CASE WHEN s < 0.7 THEN 'UNRESOLVED' WHEN s - coalesce(s2, 0) < 0.08 THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'SELECTED' END AS status FROM r WHERE k = 1""")
def best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best evidence on each page, then the best page, with a margin."""
    s = 0.35 * (1 - F.col("l_discount")) + 0.25 * (F.col("l_quantity") / 50.0) + 0.40 * (1 - F.col("l_tax"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(s).alias("s"))
    best = ranking.top_with_margin(pages, ["l_orderkey"], "s", [F.col("l_linenumber")])
    status = F.when(F.col("s") < 0.7, "UNRESOLVED").when(F.col("margin") < 0.08, "HUMAN_REVIEW_REQUIRED").otherwise("SELECTED")
    return best.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page"), F.col("s").alias("score"), status.alias("status"))


@query("""WITH v AS (SELECT user_id, CAST(props->>'k' AS INTEGER) % 3 AS value, count(*) AS support, count(DISTINCT event_type) AS sources, min(event_id) AS first_seen FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(support) OVER w, 0) AS next_support FROM v WINDOW w AS (PARTITION BY user_id ORDER BY support DESC, first_seen, value))
SELECT user_id, CASE WHEN support >= 3 AND sources >= 2 AND support > next_support THEN value END AS winner, support, next_support, sources FROM r WHERE k = 1""")
def vote_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority among event values, which needs support, sources and no tie."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.get_json_object("props", "$.k").cast("int") % 3).alias("value"))
    return ranking.vote(rows, ["user_id"], "value", "event_type", "event_id", 3, 2)


@query("""WITH w AS (SELECT conv_id, turn, role, lower(split_part(trim(text), ' ', 1)) AS value FROM conversations), v AS (SELECT conv_id, value, count(*) AS support, count(DISTINCT role) AS sources, min(turn) AS first_seen FROM w WHERE value <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER x AS k, coalesce(lead(support) OVER x, 0) AS next_support FROM v WINDOW x AS (PARTITION BY conv_id ORDER BY support DESC, first_seen, value))
SELECT conv_id, CASE WHEN support >= 2 AND support > next_support THEN value END AS winner, support, next_support, sources FROM r WHERE k = 1""")
def vote_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.nullif(F.lower(F.get(F.split(F.trim("text"), " "), F.lit(0))), F.lit("")).alias("value"))
    return ranking.vote(rows, ["conv_id"], "value", "role", "turn", 2)


@query("""WITH c AS (SELECT o_orderpriority AS field, o_orderstatus AS observed, CASE WHEN o_custkey % 20 = 0 THEN 'X' ELSE 'F' END AS corrected, o_custkey, o_orderkey FROM orders),
g AS (SELECT field, observed, corrected, count(*) AS n, count(DISTINCT o_custkey) AS docs, count(DISTINCT o_custkey % 7) AS reviewers FROM c GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY field, observed) AS total, row_number() OVER (PARTITION BY field, observed ORDER BY n DESC, corrected) AS k FROM g)
SELECT field, observed, corrected, n, CAST(n AS DOUBLE) / total AS agreement, docs >= 5 AND reviewers >= 2 AND CAST(n AS DOUBLE) / total >= 0.95 AS promote FROM r WHERE k = 1""")
def correction_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual correction of each observed value, and whether it is usual enough to be a rule."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("observed"), F.when(F.col("o_custkey") % 20 == 0, "X").otherwise("F").alias("corrected"), "o_custkey")
    g = c.groupBy("field", "observed", "corrected").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("docs"), F.countDistinct(F.col("o_custkey") % 7).alias("reviewers"))
    key = Window.partitionBy("field", "observed")
    r = g.withColumn("total", F.sum("n").over(key)).withColumn("k", F.row_number().over(key.orderBy(F.col("n").desc(), "corrected"))).filter("k = 1")
    agreement = F.col("n").cast("double") / F.col("total")
    return r.select("field", "observed", "corrected", "n", agreement.alias("agreement"), ((F.col("docs") >= 5) & (F.col("reviewers") >= 2) & (agreement >= 0.95)).alias("promote"))


@query("""WITH h AS (SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0 END FOR i IN range(1, 65)])::HUGEINT AS v FROM embeddings),
u AS (SELECT v, min(vec_id) AS k FROM h GROUP BY v)
SELECT x.k AS a, y.k AS b, CAST(bit_count(xor(x.v, y.v)) AS INTEGER) AS distance FROM u x JOIN u y ON x.k < y.k WHERE bit_count(xor(x.v, y.v)) <= 18""")
def near_duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign hashes of layout signatures that differ in at most eighteen bits."""
    bits = F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    hashes = table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("v"))
    return joins.hamming_pairs(hashes, "vec_id", "v", 18)


@query("""WITH c AS (SELECT label, list(avg) AS centre FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS avg FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i ORDER BY label, i) GROUP BY label),
s AS (SELECT vec_id, c.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre) AS s FROM embeddings, c)
SELECT vec_id, label AS nearest, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 6) DESC, label) AS k FROM s) WHERE k = 1""")
def cosine_nearest_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template (mean signature of a label) each signature is most like."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    scored = e.select("vec_id", "embedding").crossJoin(F.broadcast(centres)).select("vec_id", "label", F.round(numbers.cosine(F.col("embedding"), F.col("centre")), 6).alias("similarity"))
    return ranking.top_with_margin(scored, ["vec_id"], "similarity", [F.col("label")]).select("vec_id", F.col("label").alias("nearest"), "similarity")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, CASE WHEN o_orderstatus = 'P' THEN 20000000 + o_custkey // 12 ELSE 10000000 + o_custkey // 3 END AS b FROM orders), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS reach FROM two UNION SELECT r.node, two.b FROM r JOIN two ON r.reach = two.a)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of records that share an identity, through any number of others."""
    group = F.expr("CASE WHEN o_orderstatus = 'P' THEN 20000000 + o_custkey div 12 ELSE 10000000 + o_custkey div 3 END")
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), group.alias("b"))
    return connected_components(edges, "a", "b")
