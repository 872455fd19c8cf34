"""Pages: phrases in pieces, fields that want one place, and where fields stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflicts, localization, phrases
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

_PHRASES = {"de": ["in der", "enlich und", "von der die"], "en": ["of the", "with other", "that the thing", "in"]}
_WANTED = [(f, p, p.split()) for f, own in sorted(_PHRASES.items()) for p in own]
_CHAINS = " UNION ALL ".join(
    f"SELECT h0.page, '{family}' AS family, '{phrase}' AS phrase, h0.pos AS start, {' + '.join(f'h{k}.n' for k in range(len(words)))} AS n FROM hop h0 "
    + " ".join(f"JOIN hop h{k} ON h{k}.page = h0.page AND h{k}.word = '{words[k]}' AND h{k}.pos = h{k - 1}.pos + h{k - 1}.n" for k in range(1, len(words)))
    + f" WHERE h0.word = '{words[0]}'"
    for family, phrase, words in _WANTED
)


@query(f"""WITH line AS (SELECT conv_id AS page, turn, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM conversations), raw AS (SELECT page, turn, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM line),
tok AS (SELECT page, turn, row_number() OVER (PARTITION BY page ORDER BY turn, k) - 1 AS pos, regexp_replace(translate(lower(w), '0158', 'oisb'), '[^a-z]', '', 'g') AS t FROM raw),
ahead AS (SELECT page, pos, t AS a1, lead(t) OVER w AS a2, lead(t, 2) OVER w AS a3, lead(t, 3) OVER w AS a4 FROM tok WINDOW w AS (PARTITION BY page ORDER BY pos)),
made AS (SELECT page, pos, 1 AS n, a1 AS m FROM ahead UNION ALL SELECT page, pos, 2, a1 || a2 FROM ahead WHERE a2 IS NOT NULL UNION ALL SELECT page, pos, 3, a1 || a2 || a3 FROM ahead WHERE a3 IS NOT NULL UNION ALL SELECT page, pos, 4, a1 || a2 || a3 || a4 FROM ahead WHERE a4 IS NOT NULL),
want AS (SELECT * FROM (VALUES {", ".join(f"('{w}')" for w in sorted({w for _, _, own in _WANTED for w in own}))}) t(word)),
near AS (SELECT page, pos, n, word, m FROM made JOIN want ON m = word OR (length(word) >= 5 AND abs(length(m) - length(word)) <= 1)),
hop AS (SELECT page, word, pos, min(n) AS n FROM near WHERE m = word OR coalesce(list_sum(list_transform(range(1, least(length(m), length(word)) + 1), lambda i: CASE WHEN substr(m, i, 1) <> substr(word, i, 1) THEN 1 ELSE 0 END)), 0) + abs(length(m) - length(word)) <= 1 GROUP BY ALL),
chain AS ({_CHAINS}), spans AS (SELECT c.*, a.turn * 0.04::DOUBLE AS y0, b.turn * 0.04::DOUBLE + 0.03::DOUBLE AS y1 FROM chain c JOIN tok a ON a.page = c.page AND a.pos = c.start JOIN tok b ON b.page = c.page AND b.pos = c.start + c.n - 1),
first AS (SELECT * FROM spans WHERE y1 - y0 <= 0.14 QUALIFY row_number() OVER (PARTITION BY page, family, phrase ORDER BY start) = 1)
SELECT f.page, family, phrase, string_agg(t, ' ' ORDER BY pos) AS tokens, greatest(0.75, 1 - 0.05 * count(*) FILTER (WHERE NOT list_contains(string_split(phrase, ' '), t)))::DOUBLE AS quality, any_value(y0) AS y0, any_value(y1) AS y1
FROM first f JOIN tok ON tok.page = f.page AND tok.pos BETWEEN f.start AND f.start + f.n - 1 GROUP BY f.page, family, phrase""")
def recovered_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that conversations hold over tokens and turns, also in pieces or misread; a turn is a line of the page."""
    y = F.col("turn") * 0.04
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("ord"), "text", F.lit(0.1).alias("x0"), y.alias("y0"), F.lit(0.9).alias("x1"), (y + 0.03).alias("y1"))
    found = phrases.recovered_phrases(lines, _PHRASES)
    return found.select("page", "family", "phrase", F.array_join("tokens", " ").alias("tokens"), "quality", "y0", "y1")


#: An order has few lines, and no more rounds than lines are needed.
_MOST = 16
_ROUNDS = "".join(
    f""", c{k} AS (SELECT c.*, row_number() OVER (PARTITION BY page, place ORDER BY confidence DESC, mapping DESC, field) > 1 AS loses FROM c JOIN a{k} USING (page, field) WHERE c.k = a{k}.k), a{k + 1} AS (SELECT page, field, k + CAST(loses AS BIGINT) AS k FROM c{k})"""
    for k in range(_MOST)
)


@query(f"""WITH c AS (SELECT l_orderkey AS page, 'f' || l_linenumber % 3 AS field, l_suppkey % 3 AS place, 1 - l_discount AS confidence, 1 - l_tax AS mapping, l_linenumber AS line, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY 1 - l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
a0 AS (SELECT DISTINCT page, field, CAST(1 AS BIGINT) AS k FROM c){_ROUNDS}
SELECT c.page, c.field, c.place, c.line, c.part FROM c JOIN a{_MOST} USING (page, field) WHERE c.k = a{_MOST}.k""")
def settled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's lines the one each field ends with, where two fields may not have one place."""
    found = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("field"), (F.col("l_suppkey") % 3).alias("place"), (1 - F.col("l_discount")).alias("confidence"), (1 - F.col("l_tax")).alias("mapping"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "l_suppkey"
    )
    out = conflicts.resolved_conflicts(found, ["page"], "field", [F.col("place")], [F.col("confidence"), F.col("mapping")], [F.desc("confidence"), F.col("line"), F.col("part"), F.col("l_suppkey")])
    return out.select("page", "field", "place", "line", "part")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 250 by 800: the words of a turn, in lines of five with uneven heights."""
    words = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("page"), F.posexplode(F.split("text", " ")).alias("pos", "text"))
    x, y = (F.col("pos") % 5) * 50.0, F.floor(F.col("pos") / 5) * 12.0 + (F.col("pos") % 3) * 1.5
    return words.select(
        "page", F.col("pos").cast("string").alias("token"), "text", x.alias("x0"), y.alias("y0"), (x + 40.0).alias("x1"), (y + 9.0).alias("y1"), (0.5 + F.col("pos") * 7 % 50 / 100.0).alias("confidence"), F.floor(F.col("pos") / 5).cast("int").alias("line"),
        F.col("pos").alias("place"), F.col("pos").cast("long").alias("ord"), F.lit(250).alias("width"), F.lit(800).alias("height"),
    )


_RULES = [
    localization.FieldRule("noun", "ALPHANUMERIC_ID", ("the",), (localization.Relation("right_of"), localization.Relation("below")), neighbours=("and",), negatives=("of",), threshold=1.0),
    localization.FieldRule("joined", "OTHER", ("and",), (localization.Relation("right_of"),), zone="UPPER_LEFT", threshold=1.0),
]
_NORMAL = "trim(replace(regexp_replace(upper(replace({x}, 'ß', 'ss')), '[^A-Z0-9 ]', '', 'g'), '1', 'I'))"
_PLAIN = "trim(regexp_replace(upper(replace({x}, 'ß', 'ss')), '[^A-Z0-9 ]', '', 'g'))"


@query(f"""WITH word AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), raw AS (SELECT conv_id || '-' || turn AS page, unnest(w) AS text, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos FROM word),
tok AS (SELECT page, pos, text, pos % 5 * 50e0 AS x0, pos // 5 * 12e0 + pos % 3 * 1.5e0 AS y0, pos % 5 * 50e0 + 40e0 AS x1, pos // 5 * 12e0 + pos % 3 * 1.5e0 + 9e0 AS y1, 0.5e0 + pos * 7 % 50 / 100e0 AS conf, {_NORMAL.format(x="text")} AS n, {_PLAIN.format(x="text")} AS p,
  CASE WHEN trim(text) = '' THEN 0e0 WHEN regexp_full_match(trim(text), '[A-Za-z0-9-]{{5,24}}') THEN 0.95e0 ELSE 0.15e0 END AS grade FROM raw),
rule AS (SELECT * FROM (VALUES ('noun', 'THE', ['OF', 'AND'], true, ['right_of', 'below']), ('joined', 'AND', CAST([] AS VARCHAR[]), false, ['right_of'])) t(field, alias, declared, first, relations)),
anchored AS (SELECT page, field, alias, declared, first, relations, t.*, (0.8e0 + 0.2e0 * CASE WHEN first THEN 1e0 WHEN (x0 + x1) / (2 * 250) < 0.4e0 AND (y0 + y1) / (2 * 800) < 0.4e0 THEN 1e0 ELSE 0.45e0 END) * conf AS sure
  FROM (SELECT page AS page_, * EXCLUDE (page) FROM tok) t JOIN rule ON starts_with(n, alias) JOIN (SELECT DISTINCT page FROM tok) q ON q.page = page_ WHERE conf >= 0.45e0 AND NOT (first AND contains(n, 'OF')) QUALIFY row_number() OVER (PARTITION BY page, field ORDER BY sure DESC, pos) = 1),
near AS (SELECT a.page, a.field, a.alias, a.declared, a.first, a.sure, a.x1 AS ax1, t.pos, t.text, t.n, t.grade, t.conf, t.x0, t.y0, t.x1, t.y1, r.k, r.relation, (t.x0 + t.x1) / 2 AS tx, (t.y0 + t.y1) / 2 AS ty, (a.x0 + a.x1) / 2 AS ax, (a.y0 + a.y1) / 2 AS ay, t.y0 - a.y1 AS dy,
  greatest(0e0, least(t.y1, a.y1) - greatest(t.y0, a.y0)) / least(t.y1 - t.y0, a.y1 - a.y0) AS overlap, 0.012e0 * greatest(0, t.pos - a.pos - 1) AS late
  FROM anchored a JOIN tok t ON t.page = a.page AND t.pos <> a.pos, LATERAL (SELECT unnest(a.relations) AS relation, generate_subscripts(a.relations, 1) AS k) r
  WHERE replace(t.n, ' ', '') <> '' AND NOT contains(replace(t.n, ' ', ''), a.alias) AND NOT contains(a.alias, replace(t.n, ' ', '')) AND NOT (a.first AND t.n = 'AND')),
reach AS (SELECT *, CASE WHEN relation = 'right_of' THEN CASE WHEN tx - ax1 >= -0.015e0 * 250 AND tx - ax1 <= 0.36e0 * 250 AND abs(ty - ay) <= 0.055e0 * 800 THEN greatest(0.05e0, greatest(0.05e0, least(1e0, 0.65e0 + 0.25e0 * overlap - 0.35e0 * greatest(0e0, tx - ax1) / (0.36e0 * 250))) - late) ELSE 0e0 END
  ELSE CASE WHEN dy >= -0.008e0 * 800 AND dy <= 0.10e0 * 800 AND abs(tx - ax) <= 0.46e0 * 250 THEN greatest(0.05e0, greatest(0.05e0, least(1e0, 0.95e0 - 0.50e0 * greatest(0e0, dy) / (0.10e0 * 800) - 0.20e0 * abs(tx - ax) / (0.46e0 * 250))) - late) ELSE 0e0 END END AS g FROM near),
lab AS (SELECT page, field, pos, x0, y0, x1, y1 FROM tok, rule WHERE len(list_filter(declared, lambda d: contains(d, n) OR contains(n, d))) > 0),
boxed AS (SELECT *, CASE WHEN relation = 'right_of' THEN greatest(x0 - 0.6e0 * (y1 - y0), ax1 + 0.1e0 * (y1 - y0)) ELSE x0 - 0.6e0 * (y1 - y0) END AS bx0, y0 - 0.2e0 * (y1 - y0) AS by0, x1 + 2.25e0 * (y1 - y0) AS wide, y1 + 0.8e0 * (y1 - y0) AS by1 FROM reach WHERE g > 0),
cut AS (SELECT b.*, least(wide, (SELECT min(l.x0 - 0.2e0 * (b.y1 - b.y0)) FROM lab l WHERE l.page = b.page AND l.field = b.field AND l.pos <> b.pos AND l.x0 >= b.x1 AND l.y0 < b.by1 AND l.y1 > b.by0)) AS bx1 FROM boxed b),
clip AS (SELECT *, CAST(greatest(0, round_even(bx0, 0)) AS BIGINT) AS cx0, CAST(greatest(0, round_even(by0, 0)) AS BIGINT) AS cy0, CAST(least(250, round_even(bx1, 0)) AS BIGINT) AS cx1, CAST(least(800, round_even(by1, 0)) AS BIGINT) AS cy1 FROM cut),
one AS (SELECT * FROM clip WHERE cx1 > cx0 AND cy1 > cy0 QUALIFY row_number() OVER (PARTITION BY page, field, cx0, cy0, cx1, cy1 ORDER BY pos, k) = 1),
cross_ AS (SELECT *, CASE WHEN field = 'noun' THEN grade ELSE CASE WHEN trim(text) = '' THEN 0e0 ELSE 0.7e0 END END AS fit, CASE WHEN first THEN CASE WHEN EXISTS (SELECT 1 FROM lab l WHERE l.page = one.page AND l.field = one.field AND least(l.x1, cx1) > greatest(l.x0, cx0) AND least(l.y1, cy1) > greatest(l.y0, cy0)) THEN 0e0 ELSE 1e0 END END AS cr FROM one),
scored AS (SELECT *, least(1e0, (0.18e0 * sure + 0.30e0 * g + 0.16e0 * conf + 0.30e0 * fit + coalesce(0.03e0 * cr, 0e0)) / (0.18e0 + 0.30e0 + 0.16e0 + 0.30e0 + CASE WHEN cr IS NULL THEN 0e0 ELSE 0.03e0 END)) AS score FROM cross_),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page, field ORDER BY score DESC, pos, k) AS place FROM scored), top AS (SELECT * FROM ranked WHERE place = 1),
rival AS (SELECT r.page, r.field, arg_min(r.score, r.place) AS score FROM ranked r JOIN top t ON t.page = r.page AND t.field = r.field AND r.n <> t.n AND r.pos <> t.pos AND r.relation = t.relation AND r.fit >= 0.75e0 GROUP BY 1, 2),
inside AS (SELECT t.page, t.field, count(*) FILTER (WHERE t.first AND len(list_filter(['OF', 'AND'], lambda d: contains(d, k.p) OR contains(k.p, d))) > 0) AS fo, count(*) FILTER (WHERE contains(t.alias, k.p) OR contains(k.p, t.alias)) AS ow, count(*) FILTER (WHERE k.pos <> t.pos AND CASE WHEN t.field = 'noun' THEN k.grade ELSE CASE WHEN trim(k.text) = '' THEN 0 ELSE 0.7 END END >= 0.5) AS ex
  FROM top t JOIN tok k ON k.page = t.page AND (k.x0 + k.x1) / 2 BETWEEN cx0 AND cx1 AND (k.y0 + k.y1) / 2 BETWEEN cy0 AND cy1 GROUP BY 1, 2),
owned AS (SELECT t.*, CASE WHEN fo > 0 THEN 'WRONG_NEIGHBOR' WHEN ow > 0 THEN 'LABEL_CONTAMINATED' WHEN ex > 0 THEN 'MULTI_FIELD_CROP' WHEN t.score - v.score < 0.005e0 THEN 'REGION_AMBIGUOUS' WHEN trim(text) = '' THEN 'UNKNOWN' WHEN g < 0.5 THEN 'UNKNOWN' ELSE 'REGION_OWNED' END AS ownership
  FROM top t LEFT JOIN inside i ON i.page = t.page AND i.field = t.field LEFT JOIN rival v ON v.page = t.page AND v.field = t.field)
SELECT e.page, e.field, CASE WHEN a.page IS NULL THEN 'UNRESOLVED' WHEN o.page IS NULL THEN 'ANCHOR_FOUND' WHEN ownership IN ('REGION_OWNED', 'UNKNOWN') AND fit >= 0.5 THEN 'VALUE_SEMANTICALLY_VALIDATED' ELSE 'VALUE_SPAN_DETECTED' END AS stage, cx0 AS x0, cy0 AS y0, cx1 AS x1, cy1 AS y1, 'ANCHOR_' || upper(relation) || '_TOKEN_SPAN' AS source, trim(o.text) AS value, round(score, 6) AS score, ownership
FROM (SELECT DISTINCT page, field FROM tok, rule) e LEFT JOIN anchored a ON a.page = e.page AND a.field = e.field LEFT JOIN owned o ON o.page = e.page AND o.field = e.field""")
def located_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two fields stand on the pages that turns of conversations make, by their labels; and who owns the place."""
    out = localization.located_fields(_tokens(spark, sf_dir), _RULES)
    return out.select("page", "field", "stage", "x0", "y0", "x1", "y1", "source", "value", F.round("score", 6).alias("score"), "ownership")


_ZONES = [("A", "first", 0.1, 0.0, 0.7, 0.05), ("A", "second", 0.3, 0.04, 0.9, 0.12), ("B", "first", 0.0, 0.5, 1.0, 0.52)]


@query(f"""WITH word AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), raw AS (SELECT conv_id || '-' || turn AS page, conv_id % 3 AS c, unnest(w) AS text, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos FROM word),
tok AS (SELECT page, pos, text, pos % 5 * 50e0 AS x0, pos % 5 * 50e0 + 20e0 AS cx, pos // 5 * 12e0 + pos % 3 * 1.5e0 + 4.5e0 AS cy, 0.5e0 + pos * 7 % 50 / 100e0 AS conf, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS n FROM raw),
ask AS (SELECT DISTINCT page, field, CASE c WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS form FROM raw, (VALUES ('first'), ('second')) f(field)), zone AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{n}', {a}e0, {b}e0, {c}e0, {d}e0)" for f, n, a, b, c, d in _ZONES)}) t(form, field, zx0, zy0, zx1, zy1)),
box AS (SELECT page, field, zx0 * 250 AS x0, zy0 * 800 AS y0, zx1 * 250 AS x1, zy1 * 800 AS y1 FROM ask LEFT JOIN zone USING (form, field)),
ins AS (SELECT b.page, b.field, t.x0 AS tx, pos, trim(text) AS text, conf, cy, (b.y0 + b.y1) / 2 AS mid, CAST(round_even(cy / 12, 0) AS BIGINT) AS line FROM box b JOIN tok t ON t.page = b.page AND cx BETWEEN b.x0 AND b.x1 AND cy BETWEEN b.y0 AND b.y1 WHERE n <> 'NAME' AND NOT regexp_full_match(n, '[0-9]+') AND NOT regexp_matches(substr(n, 1, 3), '[0-9]')),
per AS (SELECT page, field, line, abs(avg(cy) - max(mid)) AS off, string_agg(text, ' ' ORDER BY tx, pos) AS value, avg(conf) AS confidence FROM ins GROUP BY 1, 2, 3), best AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY page, field ORDER BY round(off, 9), line) = 1)
SELECT b.page, b.field, value, round(confidence, 9) AS confidence, CASE WHEN x0 IS NULL THEN 'LOCALIZATION_UNCERTAIN' WHEN p.page IS NULL THEN 'EMPTY_CROP' ELSE 'CROP_SAFE' END AS outcome FROM box b LEFT JOIN best p ON p.page = b.page AND p.field = b.field""")
def name_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the zones that two of three kinds of pages have for them."""
    tokens = _tokens(spark, sf_dir)
    form = F.substring_index("page", "-", 1).cast("long") % 3
    asked = tokens.select("page").distinct().select("page", F.when(form == 0, "A").when(form == 1, "B").otherwise("C").alias("form"), F.explode(F.array(F.lit("first"), F.lit("second"))).alias("field"))
    zones = spark.createDataFrame(_ZONES, "form string, field string, x0 double, y0 double, x1 double, y1 double")
    return localization.name_regions(tokens, asked, zones).select("page", "field", "value", F.round("confidence", 9).alias("confidence"), "outcome")
