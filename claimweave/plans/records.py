"""Fixed-width records and page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fixedwidth as fw
from ..operators import layout
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

_CLAIM = [
    fw.Field("type", 1, 2, default="CL"), fw.Field("claim", 3, 10, "NUMERIC"), fw.Field("date", 13, 8, "DATE", default="00000000"), fw.Field("cents", 21, 12, "DECIMAL_IMPLIED"),
    fw.Field("status", 33, 3, align="RIGHT"), fw.Field("priority", 37, 8),
]
_LINE_SQL = """'CL' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || strftime(o_orderdate, '%Y%m%d') || lpad(CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR), 12, '0') || lpad(o_orderstatus, 3, ' ') || ' ' || rpad(substr(o_orderpriority, 1, 8), 8, ' ')"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {
        "claim": F.col("o_orderkey"), "date": F.date_format("o_orderdate", "yyyyMMdd"), "cents": (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", fw.render_record(_CLAIM, values).alias("line"))


@query(f"SELECT o_orderkey, {_LINE_SQL} AS line FROM orders")
def fixed_width_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query("""SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS claim, strftime(o_orderdate, '%Y%m%d') AS date, lpad(CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR), 12, '0') AS cents, o_orderstatus AS status, trim(substr(o_orderpriority, 1, 8)) AS priority FROM orders""")
def fixed_width_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was rendered, read back."""
    parsed = _lines(spark, sf_dir).withColumn("p", fw.parse_record(_CLAIM, F.col("line"), 44))
    return parsed.select("o_orderkey", "p.claim", "p.date", "p.cents", "p.status", "p.priority")


@query("""SELECT 'CL' AS prefix, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS wrong_length, CAST(15000 AS BIGINT) AS expected, count(*) FILTER (WHERE o_orderkey % 7 = 0) = 0 AND count(*) = 15000 AS ok FROM orders
UNION ALL SELECT 'ZZ', 0, 0, CAST(1 AS BIGINT), FALSE""")
def file_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record counts and lengths of a rendered file of which every seventh line was cut."""
    lines = _lines(spark, sf_dir).select(F.when(F.col("o_orderkey") % 7 == 0, F.expr("substring(line, 1, 40)")).otherwise(F.col("line")).alias("line"))
    return fw.file_structure(lines, "line", {"CL": 44, "ZZ": 10}, {"CL": 15000, "ZZ": 1})


@query("""SELECT CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS total FROM orders""")
def file_control_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fw.sum_field(_lines(spark, sf_dir), "line", "CL", _CLAIM[3])


@query("""WITH s AS (SELECT p_brand AS record, p_size * 4 AS start, 3 + p_partkey % 4 AS length, p_partkey FROM part), e AS (SELECT *, coalesce(max(start + length - 1) OVER (PARTITION BY record ORDER BY start, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM s)
SELECT record, CAST(start AS BIGINT) AS position, CASE WHEN start > last + 1 THEN 'GAP' ELSE 'OVERLAP' END AS kind, abs(start - last - 1) AS size FROM e WHERE start <> last + 1""")
def spec_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and overlaps between the fields of record layouts."""
    spec = table(spark, sf_dir, "part").select(F.col("p_brand").alias("record"), (F.col("p_size") * 4).cast("long").alias("start"), (F.col("p_partkey") % 4 + 3).alias("length"))
    return fw.spec_gaps(spec, "record", "start", "length")


@query("""WITH f AS (SELECT p_brand AS record, p_partkey AS line, p_size % 12 AS number, p_size % 12 * 6 + 1 AS s, p_size % 12 * 6 + 5 + p_partkey % 3 AS e FROM part), first AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY record, number ORDER BY line) = 1),
x AS (SELECT *, 1 + coalesce(max(e) OVER (PARTITION BY record ORDER BY s, e, CAST(number AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nx FROM first),
i AS (SELECT f.record, CAST(f.number AS VARCHAR) AS number, 'duplicate_field_conflict' AS code, 'defined as ' || first.s || '-' || first.e || ', then as ' || f.s || '-' || f.e AS message FROM f JOIN first ON f.record = first.record AND f.number = first.number AND f.line > first.line AND (f.s, f.e) <> (first.s, first.e)
 UNION ALL SELECT record, CAST(number AS VARCHAR), 'unexplained_gap', 'unmapped positions ' || nx || '-' || (s - 1) FROM x WHERE s > nx UNION ALL SELECT record, CAST(number AS VARCHAR), 'overlapping_field', 'starts at ' || s || ' where ' || nx || ' is free' FROM x WHERE s < nx
 UNION ALL SELECT record, CAST(number AS VARCHAR), 'picture_length_mismatch', 'picture of 6 in ' || (e - s + 1) FROM first WHERE e - s + 1 <> 6 UNION ALL SELECT record, CAST(number AS VARCHAR), 'required_field_without_name', 'required field has no name' FROM first WHERE number = 5 AND line % 2 = 0
 UNION ALL SELECT record, NULL, 'unexplained_gap', 'unmapped positions ' || (max(e) + 1) || '-72' FROM first GROUP BY record HAVING max(e) < 72 UNION ALL SELECT record, NULL, 'record_overflow', 'fields extend to ' || max(e) || ', expected 72' FROM first GROUP BY record HAVING max(e) > 72)
SELECT record, number, code, message, count(*) AS n FROM i GROUP BY ALL""")
def layout_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record layouts that go on over pages, merged; and all that is wrong with them."""
    number, start = F.col("p_size") % 12, F.col("p_size") % 12 * 6 + 1
    fields = table(spark, sf_dir, "part").select(
        F.lit("spec").alias("source"), F.col("p_partkey").alias("line"), F.col("p_brand").alias("record"), number.cast("string").alias("number"), F.when((number == 5) & (F.col("p_partkey") % 2 == 0), "").otherwise("field").alias("name"), start.alias("start"), (start + 4 + F.col("p_partkey") % 3).cast("int").alias("end"),
        F.lit("X(6)").alias("picture"), F.when(number == 5, "R").otherwise("O").alias("requirement"), F.lit("").alias("notes"),
    )
    kept, conflicts = fw.merged_sections(fields)
    records = fields.select("source", "record").distinct().withColumn("length", F.lit(72))
    issues = conflicts.drop("line").unionByName(fw.spec_issues(kept, records))
    return issues.groupBy("record", "number", "code", "message").agg(F.count(F.lit(1)).alias("n"))


_ANCHORS = {"notice": ["the", "copyright", "nav"], "article": ["<article>", "<h1>", "<p>"], "form": ["<form", "<input", "name="]}


@query(f"""WITH a AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{p}', {len(ps)})" for f, ps in _ANCHORS.items() for p in ps)}) t(family, phrase, n)), s AS (SELECT page_id, family, count(*) FILTER (WHERE contains(lower(html), phrase)) AS matched, any_value(n) AS n FROM pages, a GROUP BY 1, 2),
r AS (SELECT *, CAST(matched AS DOUBLE) / n AS confidence, row_number() OVER (PARTITION BY page_id ORDER BY CAST(matched AS DOUBLE) / n DESC, family) AS k FROM s)
SELECT page_id, CASE WHEN confidence >= 0.6 THEN family ELSE 'UNKNOWN' END AS route, confidence FROM r WHERE k = 1""")
def anchor_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family whose anchor phrases a page has most of."""
    scores = layout.anchor_scores(table(spark, sf_dir, "pages"), "page_id", F.col("html"), _ANCHORS)
    best = scores.groupBy("page_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "family")).alias("b"))
    return best.select("page_id", F.when(F.col("b.c") <= -0.6, F.col("b.family")).otherwise("UNKNOWN").alias("route"), (-F.col("b.c")).alias("confidence"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a page: the words of a conversation, in lines of five with uneven heights."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    line, x = F.floor(F.col("pos") / 5), (F.col("pos") % 5).cast("double")
    y = F.col("turn") * 100000.0 + line * 12.0 + (F.col("pos") % 3) * 1.5
    return words.select("conv_id", (F.col("turn") * 100000 + F.col("pos")).alias("ord"), "word", (x * 50).alias("x0"), y.alias("y0"), (x * 50 + 40).alias("x1"), (y + 9).alias("y1"))


@query()
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in lines and in order."""
    return layout.reading_order(_boxes(spark, sf_dir), "conv_id").select("conv_id", "ord", "line", "place")


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations), t AS (SELECT conv_id, turn * 100000 + pos // 5 AS line, 'c' || (pos % 5 // 2) AS col, turn * 100000 + pos AS ord, word FROM w),
c AS (SELECT conv_id, line, col, string_agg(word, ' ' ORDER BY ord) AS cell FROM t GROUP BY ALL), r AS (SELECT conv_id, line, string_agg(col || '=' || cell, ';' ORDER BY col) AS cells, count(*) AS n FROM c GROUP BY ALL)
SELECT conv_id, line, cells FROM r WHERE n >= 2""")
def table_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows from tokens with lines and columns."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    tokens = words.select("conv_id", (F.col("turn") * 100000 + F.floor(F.col("pos") / 5)).alias("line"), (F.col("pos") % 5).alias("p"), (F.col("turn") * 100000 + F.col("pos")).alias("ord"), "word")
    return layout.reconstruct_rows(tokens, "conv_id", "line", F.concat(F.lit("c"), F.floor(F.col("p") / 2).cast("string")), "word", "ord")


@query("""WITH l AS (SELECT conv_id, turn, role, text FROM conversations), a AS (SELECT conv_id, turn FROM l WHERE role = 'user'), v AS (SELECT conv_id, turn, regexp_extract(text, '[A-Z][a-z]+') AS value FROM l), j AS (SELECT a.conv_id, a.turn AS label_line, v.turn - a.turn AS gap, value FROM a JOIN v ON v.conv_id = a.conv_id AND v.turn BETWEEN a.turn AND a.turn + 2 WHERE value <> '')
SELECT conv_id, label_line, arg_min(value, gap) AS value, CAST(min(gap) AS INTEGER) AS gap FROM j GROUP BY 1, 2""")
def label_value_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values found on a label's line or on the two below."""
    lines = table(spark, sf_dir, "conversations")
    return layout.link_values(lines, "conv_id", "turn", F.col("role") == "user", F.nullif(F.regexp_extract("text", "[A-Z][a-z]+", 0), F.lit("")))


@query()
def family_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of each page by its best phrases, also misread ones; review below the threshold."""
    anchors = {"greeting": ["good morning to you", "thanks for the help"], "question": ["what is the", "how do i"], "statement": ["this is a", "there are many"]}
    scores = layout.family_scores(table(spark, sf_dir, "conversations").withColumn("page", F.concat_ws("-", "conv_id", "turn")), "page", F.col("text"), anchors)
    best = scores.groupBy("page").agg(F.min(F.struct((-F.col("score")).alias("s"), "family")).alias("b"))
    return best.select("page", F.when(F.col("b.s") <= -0.7, F.col("b.family")).otherwise("REVIEW").alias("route"), (-F.col("b.s")).alias("score"))


@query()
def region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at the top of the first two columns of each turn's page, if it is one row."""
    turn = F.floor(F.col("ord") / 100000)
    boxes = _boxes(spark, sf_dir).withColumn("page", F.concat_ws("-", "conv_id", turn.cast("string")))
    return layout.single_row_text(boxes, "page", "word", (F.col("x1") <= 100) & (F.col("y0") - turn * 100000 < 5))


@query("""WITH f AS (SELECT p_brand AS source, p_partkey, 'R' || p_size % 4 AS rec, p_size * 3 + 1 AS s, p_size * 3 + 1 + p_partkey % 7 AS e, p_partkey % 3 AS k, p_partkey % 5 = 0 AS wrong FROM part)
SELECT source, rec AS record, 'field_' || p_partkey AS name, CAST(s AS INTEGER) AS start, CAST(e - s + 1 AS INTEGER) AS length, CASE k WHEN 0 THEN 'NUMERIC' WHEN 1 THEN 'STRING' ELSE 'DECIMAL_IMPLIED' END AS kind, NOT wrong AS clear FROM f""")
def specification_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record layouts written out as text and read back; every fifth picture is wrong."""
    start, size, key = F.col("p_size") * 3 + 1, F.col("p_partkey") % 7 + 1, F.col("p_partkey")
    shown = F.when(key % 5 == 0, size + 1).otherwise(size).cast("string")
    picture = F.when(key % 3 == 0, F.concat(F.lit("9("), shown, F.lit(")"))).when(key % 3 == 1, F.concat(F.lit("X("), shown, F.lit(")"))).otherwise(F.concat(F.lit("9("), shown, F.lit(")V")))
    field = F.concat(F.lit("  Field "), key.cast("string"), F.lit("  "), start.cast("string"), F.lit("-"), (start + size - 1).cast("string"), F.lit(" "), picture)
    text = F.array(F.concat(F.lit("RECORD R"), (F.col("p_size") % 4).cast("string")), F.lit("-- note"), field)
    lines = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), "p_partkey", F.posexplode(text).alias("k", "line")).withColumn("number", F.col("p_partkey") * 10 + F.col("k"))
    return fw.parse_spec_text(lines, "source", "number", "line")


@query()
def label_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations that are labels, also misread ones."""
    aliases = [("cause", "because of"), ("question", "what is"), ("question", "how do"), ("thanks", "thank you"), ("article", "the")]
    return layout.detect_labels(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"), aliases)
