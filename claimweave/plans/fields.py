"""Field rules over stand-in values: datatypes, normal forms, spans, addresses, zones, calibration keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, hashing, numbers
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

_TYPES = "CASE p_partkey % 6 WHEN 0 THEN 'MEMBER_ID' WHEN 1 THEN 'ICD' WHEN 2 THEN 'INTEGER' WHEN 3 THEN 'MONEY' WHEN 4 THEN 'NAME' ELSE 'TEXT' END"
_VALUES = "CASE p_partkey % 6 WHEN 0 THEN substr(p_type, 1, 2) || ' ' || CAST(p_partkey AS VARCHAR) WHEN 1 THEN substr(p_type, 1, 1) || CAST(p_partkey AS VARCHAR) || ':' WHEN 2 THEN CAST(p_size AS VARCHAR) || substr(p_type, 1, p_size % 2) WHEN 3 THEN '$ ' || CAST(p_retailprice AS VARCHAR) ELSE p_name END"


@query(f"""WITH v AS (SELECT p_partkey, {_TYPES} AS kind, replace(trim(trim({_VALUES}), ':'), ' ', '') AS v, {_VALUES} AS raw FROM part)
SELECT p_partkey, kind, CASE kind WHEN 'MEMBER_ID' THEN regexp_full_match(v, '[A-Za-z0-9][A-Za-z0-9-]{{4,24}}') WHEN 'ICD' THEN regexp_full_match(upper(v), '[A-TV-Z][0-9]{{2}}(\\.?[A-Z0-9]{{1,4}})?') WHEN 'INTEGER' THEN regexp_full_match(v, '[0-9]+') WHEN 'MONEY' THEN regexp_full_match(v, '\\$?[0-9][0-9,]*(\\.[0-9]{{2}})?')
  WHEN 'NAME' THEN len(regexp_extract_all(raw, '[A-Za-z][A-Za-z''.-]+')) BETWEEN 2 AND 6 ELSE v <> '' END AS valid FROM v""")
def datatype_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TYPES).alias("kind"), F.expr(_VALUES.replace("VARCHAR", "STRING")).alias("v"))
    return parts.select("p_partkey", "kind", fields.valid_datatype(F.col("v"), F.col("kind")).alias("valid"))


@query(r"""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'identifier' WHEN 1 THEN 'digits' WHEN 2 THEN 'code' WHEN 3 THEN 'date' WHEN 4 THEN 'amount' ELSE 'text' END AS rule, CASE o_orderkey % 6 WHEN 3 THEN CASE WHEN o_orderkey % 5 = 0 THEN ' in  May' ELSE strftime(o_orderdate, '%m-%d-%y ') END WHEN 4 THEN CASE WHEN o_orderkey % 5 = 0 THEN '1-2 $' ELSE '($' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ')' END ELSE '  ' || o_orderpriority || '  #' || o_orderkey || '. ' END AS v, o_orderdate, o_totalprice FROM orders)
SELECT o_orderkey, rule, CASE rule WHEN 'identifier' THEN regexp_replace(upper(v), '[^A-Z0-9]', '', 'g') WHEN 'digits' THEN regexp_replace(v, '[^0-9]', '', 'g') WHEN 'code' THEN regexp_replace(upper(v), '[^A-Z0-9.]', '', 'g') WHEN 'date' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'in May' ELSE strftime(o_orderdate, '%Y-%m-%d') END
 WHEN 'amount' THEN CASE WHEN o_orderkey % 5 = 0 THEN '1-2' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END ELSE trim(regexp_replace(v, '\s+', ' ', 'g')) END AS form FROM v""")
def evaluation_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as evaluation compares them, by the field's rule."""
    k, odd = F.col("o_orderkey") % 6, F.col("o_orderkey") % 5 == 0
    rule = F.when(k == 0, "identifier").when(k == 1, "digits").when(k == 2, "code").when(k == 3, "date").when(k == 4, "amount").otherwise("text")
    day = F.when(odd, " in  May").otherwise(F.date_format("o_orderdate", "MM-dd-yy "))
    price = F.when(odd, "1-2 $").otherwise(F.concat(F.lit("($"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(")")))
    raw = F.when(k == 3, day).when(k == 4, price).otherwise(F.concat(F.lit("  "), "o_orderpriority", F.lit("  #"), F.col("o_orderkey").cast("string"), F.lit(". ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", rule.alias("rule"), fields.evaluation_form(raw, rule).alias("form"))


@query(r"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN regexp_replace(regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '') WHEN 1 THEN regexp_replace(c_name, '[^0-9]', '', 'g') WHEN 2 THEN upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) ELSE upper(c_name) END AS form FROM customer""")
def agreement_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    field = F.when(k == 0, "total_charge").when(k == 1, "birth_date").when(k == 2, "member_name").otherwise("remark")
    value = F.when(k == 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).otherwise(F.concat(F.lit(" "), F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", fields.agreement_form(field, value).alias("form"))


@query(r"""SELECT doc_id, list_extract(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}'), 1) AS first_match, list_extract(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}'), -1) AS last_match, translate(upper(regexp_extract(text, '[A-Z][a-z]+')), 'OQDILZSGB', '000112568') AS digits FROM documents""")
def span_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last number of a text, and a word read as digits."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", fields.last_match(t, "[0-9]{3}-[0-9]{4}", False).alias("first_match"), fields.last_match(t, "[0-9]{3}-[0-9]{4}", True).alias("last_match"), fields.ocr_digits(F.regexp_extract(t, "[A-Z][a-z]+", 0)).alias("digits")
    )


@query("""SELECT s_suppkey, upper(s_name) AS street, CASE WHEN s_suppkey % 2 = 0 THEN 'SUITE ' || s_suppkey END AS unit, CASE WHEN s_suppkey % 5 <> 0 THEN 'TOWN ' || s_nationkey END AS city, CASE WHEN s_suppkey % 5 <> 0 THEN 'NY' END AS state, CASE WHEN s_suppkey % 5 <> 0 THEN lpad(CAST(10000 + s_suppkey AS VARCHAR), 5, '0') END AS zip FROM supplier""")
def address_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written as lines and read back."""
    key = F.col("s_suppkey")
    place = F.concat(F.lit("Town "), F.col("s_nationkey").cast("string"), F.lit(", NY "), F.lpad((key + 10000).cast("string"), 5, "0"))
    lines = F.array_compact(F.array(F.lit("Address:"), F.col("s_name"), F.when(key % 2 == 0, F.concat(F.lit("Suite "), key.cast("string"))), F.when(key % 5 != 0, place)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", fields.address_block(lines).alias("a")).select("s_suppkey", "a.street", "a.unit", "a.city", "a.state", "a.zip")


@query("""WITH z AS (SELECT event_id, CAST(user_id % 100 AS DOUBLE) / 100 AS x, value / 60 AS y FROM events) SELECT event_id, CAST(CASE WHEN x BETWEEN 0.2::DOUBLE AND 0.6::DOUBLE AND y BETWEEN 0.1::DOUBLE AND 0.5::DOUBLE THEN 1.0
 WHEN x BETWEEN 0.2::DOUBLE - 0.08::DOUBLE AND 0.6::DOUBLE + 0.08::DOUBLE AND y BETWEEN 0.1::DOUBLE - 0.08::DOUBLE AND 0.5::DOUBLE + 0.08::DOUBLE THEN 0.65 ELSE 0.0 END AS DOUBLE) AS score FROM z""")
def zone_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside a zone of the page, near it, or outside."""
    return table(spark, sf_dir, "events").select("event_id", fields.zone_score((F.col("user_id") % 100) / 100.0, F.col("value") / 60.0, (0.2, 0.1, 0.6, 0.5)).cast("double").alias("score"))


@query("""WITH v AS (SELECT vec_id, [(SELECT 0.0)] AS x, embedding FROM embeddings), b AS (SELECT vec_id, k, sum(CAST(embedding[i] AS DOUBLE)) AS s FROM embeddings, (SELECT unnest(range(0, 8)) AS k), (SELECT unnest(range(1, 65)) AS i) WHERE (i - 1) // 8 = k GROUP BY 1, 2), n AS (SELECT vec_id, sqrt(sum(s * s)) AS norm FROM b GROUP BY 1)
SELECT b.vec_id, k AS bin, round(CASE WHEN norm > 0 THEN s / norm ELSE 0 END, 6) AS value FROM b JOIN n USING (vec_id)""")
def binned_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout signatures in eight bins, scaled."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(fields.fold_hash(F.col("embedding"), 8)).alias("bin", "value"))
    return e.select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("value", 6).alias("value"))


@query("""WITH b AS (SELECT l_discount AS d, l_tax AS t, CASE WHEN l_quantity < 3 THEN TRUE ELSE FALSE END AS empty, l_suppkey % 23 = 0 AS neighbour FROM lineitem)
SELECT CASE WHEN empty THEN 'EMPTY' WHEN neighbour THEN 'WRONG_NEIGHBOUR' WHEN 1 - d >= 0.95 AND 1 - t * 8 >= 0.5 THEN 'EXACT' WHEN 1 - d >= 0.95 THEN 'TOO_WIDE' WHEN 1 - d >= 0.5 THEN 'PARTIAL' WHEN 1 - t * 8 > 0 THEN 'SHIFTED' ELSE 'MISSED' END AS outcome, count(*) AS n FROM b GROUP BY 1""")
def region_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    outcome = fields.region_outcome(1 - F.col("l_tax") * 8, 1 - F.col("l_discount"), F.col("l_quantity") < 3, F.col("l_suppkey") % 23 == 0)
    return lines.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT * FROM (VALUES ('click', 'a', 0.9, 0.0), ('click', '*', 0.8, 0.1), ('*', 'b', 1.1, -0.1), ('*', '*', 1.0, 0.05)) t(engine, field, slope, shift)),
e AS (SELECT event_id, event_type AS engine, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS field, value / 100 AS p FROM events),
m AS (SELECT e.*, r.slope, r.shift, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN r.engine = e.engine AND r.field = e.field THEN 0 WHEN r.engine = e.engine THEN 1 WHEN r.field = e.field THEN 2 ELSE 3 END) AS k FROM e JOIN r ON r.engine IN (e.engine, '*') AND r.field IN (e.field, '*'))
SELECT event_id, round(least(greatest(p * slope + shift, 0), 1), 9) AS calibrated FROM m WHERE k = 1""")
def calibration_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each score with the most specific calibration there is: engine and field, engine, field, any."""
    registry = spark.createDataFrame([("click", "a", 0.9, 0.0), ("click", "*", 0.8, 0.1), ("*", "b", 1.1, -0.1), ("*", "*", 1.0, 0.05)], "engine string, field string, slope double, shift double")
    key = F.col("event_id") % 3
    out = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("engine"), F.when(key == 0, "a").when(key == 1, "b").otherwise("c").alias("field"), (F.col("value") / 100).alias("p"))
    steps = []
    for k, (e, f) in enumerate((("own", "own"), ("own", "*"), ("*", "own"), ("*", "*"))):
        r = registry.select(F.col("engine").alias(f"e{k}"), F.col("field").alias(f"f{k}"), F.struct("slope", "shift").alias(f"c{k}"))
        out = out.join(F.broadcast(r), (F.col(f"e{k}") == (F.col("engine") if e == "own" else F.lit("*"))) & (F.col(f"f{k}") == (F.col("field") if f == "own" else F.lit("*"))), "left")
        steps.append(F.col(f"c{k}"))
    c = F.coalesce(*steps)
    return out.select("event_id", F.round(F.least(F.greatest(F.col("p") * c["slope"] + c["shift"], F.lit(0.0)), F.lit(1.0)), 9).alias("calibrated"))


@query("""SELECT l_orderkey AS claim_id, count(*) AS n, round(avg(least(1.0, (0.5 * (1 - l_discount) + CASE WHEN l_tax > 0 THEN 0.3 * (1 - l_tax) ELSE 0 END) / (0.5 + CASE WHEN l_tax > 0 THEN 0.3 ELSE 0 END))), 9) AS score FROM lineitem GROUP BY 1""")
def weighted_location_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the signals that are known, with their weights rescaled."""
    tax = F.when(F.col("l_tax") > 0, 1 - F.col("l_tax"))
    score = numbers.weighted_mean([(1 - F.col("l_discount"), 0.5), (tax, 0.3)])
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 9).alias("score"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SAME' WHEN 1 THEN 'SOF' ELSE o_orderpriority END AS shown FROM orders""")
def output_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    state = F.when(k == 0, "SAME_AS_PATIENT").when(k == 1, "SIGNATURE_ON_FILE")
    return table(spark, sf_dir, "orders").select("o_orderkey", fields.sentinel(state, F.col("o_orderpriority")).alias("shown"))


@query("""WITH b AS (SELECT source, doc_id // 1024 AS block, sha256(string_agg(doc_id || '=' || sha256(text), ',' ORDER BY doc_id)) AS seal, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(seal, ',' ORDER BY block)) AS seal FROM b GROUP BY 1""")
def frozen_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest for each source of all its documents' digests, in order: what a freeze is checked against.

    Blocks of 1024 ids are sealed first, and the source's seal is that of its
    blocks, so that no task holds all documents of a source.
    """
    part = F.struct("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("="), F.sha2("text", 256)).alias("d"))
    joined = lambda parts, field: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p[field]), ","), 256)
    blocks = table(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id div 1024").alias("block")).agg(F.count(F.lit(1)).alias("n"), joined(part, "d").alias("seal"))
    return blocks.groupBy("source").agg(F.sum("n").alias("n"), joined(F.struct("block", "seal"), "seal").alias("seal"))


@query()
def keyed_fingerprint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source groups of two sets compared by keyed digests only."""
    d = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("side")).distinct()
    marked = d.select(hashing.hmac_sha256(F.col("source"), "overlap-key").alias("fingerprint"), "side")
    return marked.groupBy("fingerprint").agg(F.countDistinct("side").alias("sides")).filter("sides > 1")


_SWAPS = ", ".join(f"('{a}', '{b}')" for a, b in fields.CONFUSABLE.items())


@query(f"""WITH c AS (SELECT * FROM (VALUES {_SWAPS}) t(a, b)), v AS (SELECT p_partkey, upper(p_brand) AS v FROM part), p AS (SELECT p_partkey, v, i, b FROM v, (SELECT unnest(range(1, 40)) AS i) JOIN c ON TRUE WHERE substr(v, i, 1) = a),
one AS (SELECT p_partkey, i, substr(v, 1, i - 1) || b || substr(v, i + 1) AS v FROM p), two AS (SELECT one.p_partkey, substr(one.v, 1, p.i - 1) || p.b || substr(one.v, p.i + 1) AS v FROM one JOIN p ON p.p_partkey = one.p_partkey AND p.i > one.i),
u AS (SELECT p_partkey, v FROM v UNION SELECT p_partkey, v FROM one UNION SELECT p_partkey, v FROM two)
SELECT p_partkey, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(v, '.*#[0-9]+')) AS n_valid, min(v) AS first_form FROM u GROUP BY 1""")
def confusable_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with up to two confusable characters exchanged, and how many of these are valid."""
    c = table(spark, sf_dir, "part").select("p_partkey", fields.confusable_alternatives(F.col("p_brand")).alias("a"))
    return c.select("p_partkey", F.size("a").cast("long").alias("n"), F.size(F.filter("a", lambda v: v.rlike("^.*#[0-9]+$"))).cast("long").alias("n_valid"), F.array_min("a").alias("first_form"))


@query("""WITH b AS (SELECT event_id, CAST(user_id % 100 AS DOUBLE) AS x0, value AS y0, CAST(user_id % 100 AS DOUBLE) + 30 AS x1, value + 10 AS y1 FROM events), c AS (SELECT event_id, k, CASE WHEN k IN (0, 3) THEN x0 ELSE x1 END AS x, CASE WHEN k IN (0, 1) THEN y0 ELSE y1 END AS y FROM b, (SELECT unnest(range(0, 4)) AS k)),
m AS (SELECT event_id, (x * 1.1 + y * 0.05 + 3) / (x * 0.0002 + y * 0.0001 + 1) AS mx, (x * -0.04 + y * 0.95 - 2) / (x * 0.0002 + y * 0.0001 + 1) AS my FROM c)
SELECT event_id, round(min(mx), 6) AS x0, round(min(my), 6) AS y0, round(max(mx), 6) AS x1, round(max(my), 6) AS y1, TRUE AS convex FROM m GROUP BY 1""")
def registered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template boxes brought onto a page by its homography."""
    x, y = (F.col("user_id") % 100).cast("double"), F.col("value")
    box = fields.transformed_box([x, y, x + 30, y + 10], [1.1, 0.05, 3.0, -0.04, 0.95, -2.0, 0.0002, 0.0001, 1.0])
    return table(spark, sf_dir, "events").select("event_id", box.alias("b")).select("event_id", *(F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")), "b.convex")


_CELL = "CASE l_linenumber % 4 WHEN 0 THEN ' $' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {text}) || CASE WHEN l_suppkey % 3 = 0 THEN '0' ELSE '' END WHEN 1 THEN CAST(l_suppkey % 14 AS {text}) || '/1-' || CAST(l_partkey % 100 + 100 * (l_suppkey % 2) AS {text}) WHEN 2 THEN CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'j' || CAST(l_partkey % 100000 AS {text}) || ' .' END ELSE l_returnflag || '  ' || l_linestatus END"
_COLUMN = "CASE l_linenumber % 4 WHEN 0 THEN 'Total_Charge' WHEN 1 THEN 'service_date' WHEN 2 THEN 'diagnosis' ELSE 'remark' END"


@query(f"""WITH c AS (SELECT {_CELL.format(text="VARCHAR")} AS raw, {_COLUMN} AS col, l_extendedprice AS price, l_suppkey AS s, l_partkey AS p FROM lineitem),
v AS (SELECT *, CASE WHEN raw = '' THEN 'VALID_BLANK' WHEN col = 'Total_Charge' THEN CASE WHEN s % 3 = 0 THEN 'INVALID' ELSE 'VALID' END WHEN col = 'service_date' THEN CASE WHEN s % 14 BETWEEN 1 AND 12 AND s % 2 = 0 AND p % 100 >= 10 THEN 'VALID' ELSE 'INVALID' END WHEN col = 'diagnosis' THEN 'VALID' ELSE 'NOT_APPLICABLE' END AS status FROM c),
w AS (SELECT col, status, CASE WHEN raw = '' THEN '' WHEN col = 'diagnosis' THEN 'J' || p % 100000 WHEN col = 'remark' THEN regexp_replace(raw, ' +', ' ', 'g') WHEN status = 'INVALID' THEN trim(raw) WHEN col = 'Total_Charge' THEN CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) ELSE printf('20%02d-%02d-01', p % 100, s % 14) END AS value,
 CASE WHEN raw = '' THEN 'PRESERVE_BLANK' WHEN col = 'Total_Charge' THEN 'CURRENCY_EVIDENCE' WHEN col = 'service_date' THEN 'VALID_DATE_ISO' WHEN col = 'diagnosis' THEN 'CODE_CASE_SPACE' ELSE 'WHITESPACE_ONLY' END AS change FROM v)
SELECT col, status, change, count(*) AS n, min(value) AS least, max(value) AS most FROM w GROUP BY 1, 2, 3""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of service line tables put in their column's form."""
    c = table(spark, sf_dir, "lineitem").select(F.expr(_CELL.format(text="STRING")).alias("raw"), F.expr(_COLUMN).alias("col"))
    # many cells are alike, and the least text of a group is found by sorting: each different one is put in form once
    v = c.groupBy("raw", "col").agg(F.count(F.lit(1)).alias("n")).select("col", "n", fields.table_cell(F.col("raw"), F.col("col")).alias("c"))
    return v.groupBy("col", "c.status", "c.change").agg(F.sum("n").alias("n"), F.min("c.value").alias("least"), F.max("c.value").alias("most"))


@query("""WITH c AS (SELECT l_suppkey % 20 AS wide, l_linenumber AS page, l_partkey % 50 - 1 AS idx, l_quantity / 49 AS conf, CASE WHEN l_suppkey % 9 = 0 THEN 'x' ELSE sha256(CAST(l_orderkey AS VARCHAR)) END AS digest, CASE l_returnflag WHEN 'R' THEN 'REVIEW_ONLY' WHEN 'A' THEN 'PROMOTED' END AS status, l_linestatus = 'F' AS acc FROM lineitem),
f AS (SELECT concat_ws(',', CASE WHEN wide = 0 THEN 'BOX_WITHOUT_AREA' END, CASE WHEN page - 1 < 1 THEN 'PAGE_NOT_VALID' END, CASE WHEN idx < 0 THEN 'INDEX_NOT_VALID' END, CASE WHEN conf > 1 THEN 'CONFIDENCE_NOT_VALID' END, CASE WHEN digest = 'x' THEN 'DIGEST_NOT_VALID' END, CASE WHEN acc AND coalesce(status, 'REVIEW_ONLY') = 'REVIEW_ONLY' THEN 'REVIEW_ONLY_IS_NEVER_AUTOMATIC' END) AS faults FROM c)
SELECT faults, count(*) AS n FROM f GROUP BY 1""")
def cell_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of table cells by all that is wrong with them."""
    c, zero = F.col, F.lit(0)
    digest = F.when(c("l_suppkey") % 9 == 0, "x").otherwise(F.sha2(c("l_orderkey").cast("string"), 256))
    status = F.when(c("l_returnflag") == "R", "REVIEW_ONLY").when(c("l_returnflag") == "A", "PROMOTED")
    faults = fields.cell_faults([zero, zero, c("l_suppkey") % 20, F.lit(9)], c("l_linenumber") - 1, [zero, c("l_partkey") % 50 - 1], c("l_quantity") / 49, digest, status, c("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").select(F.array_join(faults, ",").alias("faults")).groupBy("faults").agg(F.count(F.lit(1)).alias("n"))


_VOCABULARY = ("office", "visit", "brief", "therapy")


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'office visit' WHEN 1 THEN 'offlce visit' WHEN 2 THEN 'brief vislt x' ELSE 'therapy note' END AS a, CASE o_custkey % 3 WHEN 0 THEN 'office visit' WHEN 1 THEN 'officc visil' ELSE 'therapv nota' END AS b FROM orders),
w AS (SELECT o_orderkey, a, b, len(string_split(a, ' ')) = len(string_split(b, ' ')) AS same, i, string_split(a, ' ')[i] AS p, string_split(b, ' ')[i] AS q FROM r, (SELECT unnest([1, 2]) AS i)), v AS (SELECT unnest(['office', 'visit', 'brief', 'therapy']) AS v),
t AS (SELECT o_orderkey, same, i, CASE WHEN p = q THEN p ELSE coalesce((SELECT min(v) FROM v WHERE levenshtein(v, p) <= 1 AND levenshtein(v, q) <= 1), CASE WHEN levenshtein(p, q) <= 2 THEN p END) END AS word FROM w)
SELECT o_orderkey, CASE WHEN bool_and(same) AND count(word) = 2 THEN string_agg(word, ' ' ORDER BY i) END AS fused FROM t GROUP BY 1""")
def fused_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a description made one by a vocabulary."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    a = F.when(k == 0, "office visit").when(k == 1, "offlce visit").when(k == 2, "brief vislt x").otherwise("therapy note")
    b = F.when(c == 0, "office visit").when(c == 1, "officc visil").otherwise("therapv nota")
    return table(spark, sf_dir, "orders").select("o_orderkey", fields.fused_tokens(a, b, F.array(*map(F.lit, _VOCABULARY))).alias("fused"))
