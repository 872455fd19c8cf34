"""Claims: normalised values, validation, reconciliation, evidence and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import evidence, rules, totals
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

AS_OF = "1998-12-31"


def _claim_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each claim: reported total, sum of its service lines at cents (null without lines)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(numbers.cents(F.col("l_extendedprice"))).alias("line_total"), F.count(F.lit(1)).alias("n_lines"))
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    # claims of every third number report what their lines add up to
    reported = F.when(F.col("o_orderkey") % 3 == 0, F.coalesce(F.col("line_total"), numbers.cents(F.col("o_totalprice")))).otherwise(numbers.cents(F.col("o_totalprice")))
    return joined.select(F.col("o_orderkey").alias("claim_id"), "o_custkey", "o_orderpriority", "o_orderdate", reported.cast("decimal(28,2)").alias("reported"), "line_total", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


CLAIM_TOTALS_SQL = """
claim AS (
  SELECT o_orderkey AS claim_id, o_custkey, o_orderpriority, o_orderdate,
    CASE WHEN o_orderkey % 3 = 0 THEN coalesce(line_total, CAST(o_totalprice AS DECIMAL(18,2))) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS reported, line_total, coalesce(n_lines, 0) AS n_lines
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS line_total, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
)"""

_STATE_SQL = """CASE WHEN line_total IS NULL THEN 'MISSING_SERVICE_LINES'
    WHEN abs(reported - line_total) <= greatest(0.01, CAST(greatest(abs(reported), abs(line_total), 1.00) * 0.0001 AS DECIMAL(18,6))) THEN 'PASS' ELSE 'CONTRADICTION' END"""


def _state():
    total, lines = F.col("reported"), F.col("line_total")
    return F.when(lines.isNull(), "MISSING_SERVICE_LINES").when(F.abs(total - lines) <= numbers.money_tolerance(total, lines), "PASS").otherwise("CONTRADICTION")


@query(f"WITH {CLAIM_TOTALS_SQL} SELECT claim_id, CAST(reported AS DOUBLE) AS reported, CAST(line_total AS DOUBLE) AS line_total, CAST(n_lines AS BIGINT) AS n_lines, {_STATE_SQL} AS state FROM claim")
def claim_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim's reported total against the sum of its service lines, within tolerance."""
    claims = _claim_totals(spark, sf_dir)
    return claims.select("claim_id", F.col("reported").cast("double").alias("reported"), F.col("line_total").cast("double").alias("line_total"), "n_lines", _state().alias("state"))


@query(f"""WITH {CLAIM_TOTALS_SQL}, s AS (SELECT *, {_STATE_SQL} AS state FROM claim)
SELECT state, count(*) AS n_claims, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(reported) AS DOUBLE) AS reported FROM s GROUP BY state""")
def claim_reconciliation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, lines and amounts by reconciliation state."""
    return (
        _claim_totals(spark, sf_dir).withColumn("state", _state()).groupBy("state")
        .agg(F.count(F.lit(1)).alias("n_claims"), F.sum("n_lines").alias("n_lines"), F.sum("reported").cast("double").alias("reported"))
    )


_TOTAL = "CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '$' || CAST(s AS {text}) WHEN 3 THEN CAST(s AS {text}) WHEN 4 THEN CAST(s AS {text}) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {text}) END"
_CHARGE = "CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 2 THEN '1O.00' WHEN l_orderkey % 5 = 0 THEN ' ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {text}) ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {text}) END"


@query(f"""WITH l AS (SELECT l_orderkey AS o_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, bool_or(l_orderkey % 7 = 0 AND l_linenumber = 2) AS bad FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey, {_TOTAL.format(text="VARCHAR")} AS total, s, bad, o_totalprice FROM orders LEFT JOIN l USING (o_orderkey)),
m AS (SELECT *, CASE WHEN total = '' OR total = 'n/a' OR total IS NULL THEN NULL ELSE CAST(replace(total, '$', '') AS DECIMAL(18,2)) END AS t FROM t)
SELECT o_orderkey AS claim_id, CAST(CASE WHEN t IS NOT NULL AND NOT bad THEN t - s END AS DOUBLE) AS difference, CASE WHEN t IS NULL THEN 'MISSING_TOTAL' WHEN s IS NULL THEN 'MISSING_SERVICE_LINES' WHEN bad THEN 'AMBIGUOUS' WHEN t <> s THEN 'ARITHMETIC_CONFLICT' WHEN total LIKE '$%' OR o_orderkey % 5 = 0 THEN 'DETERMINISTIC_NORMALIZATION_MATCH' ELSE 'EXACT_MATCH' END AS state FROM m""")
def claim_reconciliation_six_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and charges as they are written, some wrongly, against each other: strictly, to the cent."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_orderkey", "l_extendedprice")
    sums = lines.groupBy("o_orderkey").agg(F.sum(numbers.cents(F.col("l_extendedprice"))).alias("s"))
    claims = table(spark, sf_dir, "orders").join(sums, "o_orderkey", "left")
    states = totals.reconciled(claims, lines, "o_orderkey", F.expr(_TOTAL.format(text="STRING")), F.expr(_CHARGE.format(text="STRING")))
    return states.select(F.col("o_orderkey").alias("claim_id"), F.col("difference").cast("double").alias("difference"), "state")


@query("""SELECT l_orderkey AS claim_id, l_linenumber AS line_number, count(*) AS n, count(*) FILTER (WHERE abs(charge - expected) <= greatest(0.01, CAST(greatest(abs(charge), abs(expected), 1.00) * 0.0001 AS DECIMAL(18,6)))) AS n_pass
FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS charge, CAST(CAST(l_quantity AS DECIMAL(10,2)) * CAST(p_retailprice AS DECIMAL(10,2)) AS DECIMAL(18,2)) AS expected FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2""")
def service_line_rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units times the code's rate against each line's charge."""
    lines, codes = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    charge = numbers.cents(F.col("l_extendedprice"))
    expected = numbers.cents(F.col("l_quantity").cast("decimal(10,2)") * F.col("p_retailprice").cast("decimal(10,2)"))
    ok = F.abs(charge - expected) <= numbers.money_tolerance(charge, expected)
    return (
        lines.join(codes.select("p_partkey", "p_retailprice"), lines["l_partkey"] == codes["p_partkey"])
        .groupBy(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line_number")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_pass"))
    )


@query(r"""SELECT conv_id, turn, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS clean, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS INTEGER) AS n_digits, regexp_replace(regexp_replace(lower(role), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS role_slug FROM conversations""")
def normalize_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_text(F.col("text")).alias("clean"), F.length(text.only_digits(F.col("text"))).alias("n_digits"), text.slug(F.col("role")).alias("role_slug"))


@query(r"""SELECT p_partkey, nullif(upper(regexp_replace(p_type, '\s+', '', 'g')), '') AS code, CASE WHEN length(regexp_replace(p_brand, '[^0-9]', '', 'g')) = 2 THEN regexp_replace(p_brand, '[^0-9]', '', 'g') END AS brand_digits,
  CASE upper(trim(CASE p_size % 5 WHEN 0 THEN 'x' WHEN 1 THEN '[ ]' WHEN 2 THEN ' Yes ' WHEN 3 THEN '?' ELSE '' END)) WHEN 'X' THEN TRUE WHEN 'YES' THEN TRUE WHEN '[ ]' THEN FALSE WHEN '' THEN FALSE END AS checked FROM part""")
def normalize_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.element_at(F.array(*map(F.lit, ("x", "[ ]", " Yes ", "?", ""))), F.col("p_size") % 5 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_code(F.col("p_type")).alias("code"), text.digits_of_length(F.col("p_brand"), 2).alias("brand_digits"), text.normalize_checkbox(box).alias("checked"))


@query("""SELECT c_custkey, CAST(CASE WHEN v IS NULL THEN NULL WHEN c_acctbal < 0 THEN -v ELSE v END AS DOUBLE) AS amount
FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(round_even(CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS DECIMAL(20,6)) + 0.005, 2) AS DECIMAL(18,2)) END AS v FROM customer)""")
def parse_currency_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances written as amounts with half cents, signs in parentheses; every 17th is no amount."""
    value = F.abs(F.col("c_acctbal")).cast("decimal(18,2)")
    shown = F.concat(value.cast("string"), F.lit("5"))
    raw = F.when(F.col("c_custkey") % 17 == 0, "n/a").when(F.col("c_acctbal") < 0, F.concat(F.lit("($"), shown, F.lit(")"))).otherwise(F.concat(F.lit("$ "), shown))
    return table(spark, sf_dir, "customer").select("c_custkey", text.money(raw).cast("double").alias("amount"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def parse_dates_in_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim dates written in five formats and one wrong way, read back."""
    day = F.to_date("o_orderdate")
    forms = [F.date_format(day, f) for f in ("MM-dd-yy", "MM/dd/yyyy", "M/d/yy", "M-d-yyyy", "MMddyyyy")]
    raw = F.lit("31/31/1995")
    for k, form in enumerate(forms):
        raw = F.when(F.col("o_orderkey") % 6 == k, form).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(raw).alias("parsed"))


_LUHN_SQL = "(SELECT sum(CASE WHEN v > 9 THEN v - 9 ELSE v END) FROM (SELECT CAST(substr('80840' || {x}, 16 - i, 1) AS INTEGER) * (1 + (i - 1) % 2) AS v FROM (SELECT unnest(range(1, 16)) AS i))) % 10 = 0"


@query(f"""WITH n AS (SELECT s_suppkey, lpad(CAST((s_suppkey * 7919 + 1000000000) % 9000000000 + 1000000000 AS VARCHAR), 10, '0') AS npi FROM supplier),
p AS (SELECT s_suppkey, npi, substr(npi, 2, 9) AS short, substr('123456789', d, 1) || substr(npi, 2, 9) AS tried FROM n, (SELECT unnest(range(1, 10)) AS d)),
r AS (SELECT s_suppkey, max(tried) AS fit FROM p WHERE {_LUHN_SQL.format(x="tried")} GROUP BY s_suppkey HAVING count(*) = 1)
SELECT n.s_suppkey, npi, {_LUHN_SQL.format(x="npi")} AS valid, fit AS repaired FROM n LEFT JOIN r ON n.s_suppkey = r.s_suppkey""")
def npi_check_and_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider numbers made from keys: checksum, and the one leading digit that would make it right."""
    npi = F.lpad(((F.col("s_suppkey") * 7919 + 1000000000) % 9000000000 + 1000000000).cast("string"), 10, "0")
    return table(spark, sf_dir, "supplier").select("s_suppkey", npi.alias("npi")).select("s_suppkey", "npi", text.valid_npi(F.col("npi")).alias("valid"), text.repair_npi(F.substring("npi", 2, 9)).alias("repaired"))


@query("""WITH c AS (SELECT p_partkey, upper(trim(substr(p_brand, 7, 1) || '' || substr(p_type, 1, 1))) AS a, upper(substr(p_type, 1, 1)) || lpad(CAST(p_size AS VARCHAR), 2, '0') || CASE WHEN p_size % 3 = 0 THEN '.' || CAST(p_partkey % 100 AS VARCHAR) ELSE '' END AS icd, CAST(p_partkey % 100000 AS VARCHAR) AS cpt, upper(substr(p_type, 1, 1)) || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS hcpcs FROM part)
SELECT p_partkey, regexp_full_match(icd, '[A-TV-Z][0-9A-Z]{2}(\\.?[0-9A-Z]{1,4})?') AS icd10_ok, regexp_full_match(cpt, '[0-9]{5}') AS cpt_ok, regexp_full_match(hcpcs, '[A-Z][0-9]{4}') AS hcpcs_ok, regexp_full_match(a, '[0-9A-Z]{2}') AS modifier_ok, regexp_full_match(icd, '[A-TV-Z][0-9A-Z]{2}(\\.?[0-9A-Z]{1,4})?') AND regexp_full_match(cpt, '[A-TV-Z][0-9A-Z]{2}(\\.?[0-9A-Z]{1,4})?') AS both_icd10 FROM c""".replace("\\\\", "\\"))
def code_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax of diagnosis, procedure and modifier codes made from parts."""
    kind = F.upper(F.substring("p_type", 1, 1))
    icd = F.concat(kind, F.lpad(F.col("p_size").cast("string"), 2, "0"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("."), (F.col("p_partkey") % 100).cast("string"))).otherwise(""))
    cpt = (F.col("p_partkey") % 100000).cast("string")
    hcpcs = F.concat(kind, F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))
    modifier = F.concat(F.substring("p_brand", 7, 1), F.substring("p_type", 1, 1))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.matches_code(icd, text.ICD10).alias("icd10_ok"), text.matches_code(cpt, text.CPT).alias("cpt_ok"), text.matches_code(hcpcs, text.HCPCS).alias("hcpcs_ok"),
        text.matches_code(modifier, text.MODIFIER).alias("modifier_ok"), text.all_codes_match(F.concat_ws(", ", icd, cpt), text.ICD10).alias("both_icd10"),
    )


@query("""SELECT event_id, props, CASE WHEN CAST(props->>'k' AS INTEGER) % 2 = 0 THEN 'REDACTED' ELSE props->>'k' END AS kept FROM events""")
def redact_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as a map, of which values under personal keys are replaced."""
    e = table(spark, sf_dir, "events")
    values = F.from_json("props", "map<string,string>")
    renamed = F.transform_keys(values, lambda k, v: F.when(v.cast("int") % 2 == 0, F.concat(F.lit("member_"), k)).otherwise(k))
    return e.select("event_id", "props", F.get(F.map_values(text.redact_map(renamed, ("member", "ssn"))), F.lit(0)).alias("kept"))


_LABELS = ("the", "and", "patient name", "la que", "das ist")


@query(f"""SELECT doc_id, value <> '' AND NOT ({" OR ".join(f"contains('{x.upper()}', value)" for x in _LABELS)}) AS passes, (CASE WHEN list_contains(w, 'the') THEN 1 ELSE 0 END + CASE WHEN list_contains(w, 'and') THEN 1 ELSE 0 END + CASE WHEN list_contains(w, 'of') THEN 1 ELSE 0 END) >= 2 AS contaminated
FROM (SELECT doc_id, upper(trim(split_part(text, ' ', 2))) AS value, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM documents)""")
def label_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are labels or parts of one, and values full of their field's own words."""
    docs = table(spark, sf_dir, "documents")
    value = F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit(""))
    return docs.select("doc_id", text.firewall(value, F.array(*map(F.lit, _LABELS))).alias("passes"), text.label_contaminated(F.lit("the_and_of"), F.col("text")).alias("contaminated"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(o_orderdate AS DATE) AS d, o_custkey, o_orderstatus FROM orders)
SELECT claim_id, rule, severity FROM (
  SELECT o_orderkey AS claim_id, 'DATE_NOT_IN_FUTURE' AS rule, 'error' AS severity FROM o WHERE NOT d <= DATE '1998-01-01'
  UNION ALL SELECT o_orderkey, 'MEMBER_PRESENT', 'error' FROM o WHERE o_custkey % 50 = 0
  UNION ALL SELECT o_orderkey, 'NON_NEGATIVE_TOTAL', 'error' FROM o WHERE NOT total >= 0
  UNION ALL SELECT o_orderkey, 'STATUS_FINAL', 'warning' FROM o WHERE NOT o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, 'TIMELY_FILING', 'warning' FROM o WHERE NOT (date_diff('day', d, DATE '1998-12-31') BETWEEN 0 AND 365))""")
def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of every claim, one row each."""
    day, member = F.to_date("o_orderdate"), F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey"))
    checks = {
        "DATE_NOT_IN_FUTURE": (dates.not_after(day, F.lit("1998-01-01").cast("date")), "error"),
        "MEMBER_PRESENT": (member.isNotNull(), "error"),
        "NON_NEGATIVE_TOTAL": (numbers.cents(F.col("o_totalprice")) >= 0, "error"),
        "STATUS_FINAL": (F.col("o_orderstatus") == "F", "warning"),
        "TIMELY_FILING": (dates.within_filing_window(day, F.lit(AS_OF).cast("date")), "warning"),
    }
    orders = table(spark, sf_dir, "orders").withColumn("claim_id", F.col("o_orderkey"))
    return rules.findings(orders, "claim_id", checks)


@query("""WITH field AS (SELECT DISTINCT l_orderkey AS claim_id, l_returnflag AS field FROM lineitem), wanted AS (SELECT unnest(['A', 'N', 'R']) AS field)
SELECT c.claim_id, w.field FROM (SELECT DISTINCT claim_id FROM field) c, wanted w WHERE NOT EXISTS (SELECT 1 FROM field f WHERE f.claim_id = c.claim_id AND f.field = w.field)""")
def required_fields_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_returnflag").alias("field"))
    return rules.missing_required(present, spark.createDataFrame([("A",), ("N",), ("R",)], "field string"), ["field"], "claim_id")


_POLICY = [["E1", "E4"], ["E2", "E3"], ["E5"]]


@query("""WITH e AS (SELECT l_orderkey AS claim_id, list_sort(list_distinct(list(CASE l_returnflag WHEN 'A' THEN 'E1' WHEN 'N' THEN 'E2' ELSE 'E3' END) || list(CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN 'E4' END) || list(CASE WHEN l_discount >= 0.1 THEN 'E5' END))) AS raw FROM lineitem GROUP BY 1),
f AS (SELECT claim_id, list_filter(raw, lambda x: x IS NOT NULL) AS a FROM e),
o AS (SELECT claim_id, a, unnest([['E1','E4'],['E2','E3'],['E5']]) AS opt FROM f),
g AS (SELECT claim_id, array_to_string(a, '+') AS available, list_sort(list_filter(opt, lambda x: NOT list_contains(a, x))) AS miss, len(opt) AS size FROM o)
SELECT claim_id, any_value(available) AS available, bool_or(len(miss) = 0) AS satisfied, arg_min(array_to_string(miss, '+'), {'n': len(miss), 's': size, 'm': array_to_string(miss, '+')}) AS missing FROM g GROUP BY claim_id""")
def evidence_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence classes of each claim against alternatives, and what the nearest one still needs."""
    kind = F.when(F.col("l_returnflag") == "A", "E1").when(F.col("l_returnflag") == "N", "E2").otherwise("E3")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(
        F.array_sort(F.array_union(F.collect_set(kind), F.array_union(F.collect_set(F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), "E4")), F.collect_set(F.when(F.col("l_discount") >= 0.1, "E5"))))).alias("a")
    )
    options = evidence.alternatives(_POLICY)
    return lines.select("claim_id", F.array_join("a", "+").alias("available"), evidence.satisfied(options, F.col("a")).alias("satisfied"), evidence.closest_missing(options, F.col("a")).alias("missing"))


_DECISION_SQL = f"""WITH {CLAIM_TOTALS_SQL}, b AS (
  SELECT l_orderkey, list_sort(list_distinct(list(CASE WHEN l_discount >= 0.1 THEN 'discount' END) || list(CASE WHEN l_tax >= 0.08 THEN 'tax' END) || list(CASE WHEN l_quantity >= 50 THEN 'units' END))) AS raw FROM lineitem GROUP BY 1
), d AS (
  SELECT claim_id, {_STATE_SQL} AS state, coalesce(list_filter(raw, lambda x: x IS NOT NULL), []) AS blockers FROM claim LEFT JOIN b ON l_orderkey = claim_id
), x AS (
  SELECT claim_id, array_to_string(blockers, '+') AS blockers, CASE WHEN state = 'MISSING_SERVICE_LINES' THEN 'REVIEW_MISSING' WHEN state = 'CONTRADICTION' THEN 'REVIEW_CONTRADICTION'
    WHEN list_contains(blockers, 'discount') AND list_contains(blockers, 'tax') THEN 'REVIEW_COORDINATED' WHEN len(blockers) > 0 THEN 'REVIEW_BLOCKED' ELSE 'SAFE_STP' END AS decision FROM d)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.array_union(F.collect_set(F.when(F.col("l_discount") >= 0.1, "discount")), F.array_union(F.collect_set(F.when(F.col("l_tax") >= 0.08, "tax")), F.collect_set(F.when(F.col("l_quantity") >= 50, "units"))))).alias("b")
    )
    claims = _claim_totals(spark, sf_dir).withColumn("state", _state())
    joined = claims.join(blocked, claims["claim_id"] == blocked["l_orderkey"], "left").withColumn("b", F.coalesce("b", F.array().cast("array<string>")))
    decision = (
        F.when(F.col("state") == "MISSING_SERVICE_LINES", "REVIEW_MISSING").when(F.col("state") == "CONTRADICTION", "REVIEW_CONTRADICTION")
        .when(evidence.coordinated([["discount", "tax"]], F.col("b")), "REVIEW_COORDINATED").when(F.size("b") > 0, "REVIEW_BLOCKED").otherwise("SAFE_STP")
    )
    return joined.select("claim_id", F.col("b").alias("blocker_set"), F.array_join("b", "+").alias("blockers"), decision.alias("decision"))


@query(f"{_DECISION_SQL} SELECT claim_id, blockers, decision FROM x")
def claim_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason on the ladder that keeps a claim from straight-through processing."""
    return _decisions(spark, sf_dir).drop("blocker_set")


@query(f"""{_DECISION_SQL} SELECT count(*) AS n_claims, count(*) FILTER (WHERE decision = 'SAFE_STP') AS n_stp, CAST(count(*) FILTER (WHERE decision = 'SAFE_STP') AS DOUBLE) / count(*) AS stp_rate,
 CAST(count(*) FILTER (WHERE blockers <> '' AND NOT contains(blockers, '+')) AS DOUBLE) / nullif(count(*) FILTER (WHERE blockers <> ''), 0) AS single_blocker_share FROM x""")
def stp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir)
    return d.agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("decision") == "SAFE_STP").alias("n_stp"), numbers.rate(F.count_if(F.col("decision") == "SAFE_STP"), F.count(F.lit(1))).alias("stp_rate"),
        numbers.defined_rate(F.count_if(F.size("blocker_set") == 1), F.count_if(F.size("blocker_set") > 0)).alias("single_blocker_share"),
    )


@query(f"""{_DECISION_SQL} SELECT blockers, count(*) AS n_claims, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM x WHERE blockers <> '' GROUP BY blockers""")
def blocker_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each exact set of blockers occurs."""
    d = _decisions(spark, sf_dir).filter("blockers <> ''")
    total = d.agg(F.count(F.lit(1)).alias("all"))
    return d.groupBy("blockers").agg(F.count(F.lit(1)).alias("n_claims")).crossJoin(F.broadcast(total)).select("blockers", "n_claims", (F.col("n_claims").cast("double") / F.col("all")).alias("share"))


@query(f"""{_DECISION_SQL}, f AS (SELECT unnest(['discount', 'tax', 'units']) AS field) SELECT field, count(*) FILTER (WHERE contains('+' || blockers || '+', '+' || field || '+')) AS n_blocked, count(*) FILTER (WHERE blockers = field) AS n_unlocked FROM x, f GROUP BY field""")
def claim_unlock_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a field blocks, and those it alone blocks."""
    d = _decisions(spark, sf_dir).filter(F.size("blocker_set") > 0).select(F.explode("blocker_set").alias("field"), F.size("blocker_set").alias("n"))
    return d.groupBy("field").agg(F.count(F.lit(1)).alias("n_blocked"), F.count_if(F.col("n") == 1).alias("n_unlocked"))


@query(f"""{_DECISION_SQL} SELECT least(CASE WHEN blockers = '' THEN 0 ELSE len(string_split(blockers, '+')) END, 5) AS distance, count(*) AS n_claims FROM x GROUP BY 1""")
def unlock_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by how many fields still block them."""
    return _decisions(spark, sf_dir).groupBy(F.least(F.size("blocker_set"), F.lit(5)).cast("long").alias("distance")).agg(F.count(F.lit(1)).alias("n_claims"))


@query("""WITH g AS (SELECT o_orderpriority AS segment, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders GROUP BY 1)
SELECT segment, n, concat_ws(',', CASE WHEN NOT n >= 3000 THEN 'ENOUGH_CLAIMS' END, CASE WHEN NOT CAST(done AS DOUBLE) / n >= 0.33 THEN 'COMPLETION' END, CASE WHEN NOT amount / n <= 260000 THEN 'MEAN_AMOUNT' END) AS failed FROM g""")
def readiness_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments against thresholds, with the names of the gates they fail."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.sum(numbers.cents(F.col("o_totalprice"))).alias("amount")
    )
    gates = {"enough_claims": F.col("n") >= 3000, "completion": F.col("done").cast("double") / F.col("n") >= 0.33, "mean_amount": (F.col("amount") / F.col("n")).cast("double") <= 260000}
    return g.select("segment", "n", rules.failed_gates(gates).alias("failed"))
