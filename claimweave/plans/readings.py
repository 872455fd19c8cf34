"""Raw readings over stand-in columns of the tables: what they may mean, and which are taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import readings
from ..sources.tables import table
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query

#: Text of both dialects.
_FIELD = "CASE o_orderkey % 8 WHEN 0 THEN 'patient_last' WHEN 1 THEN 'patient_first' WHEN 2 THEN 'federal_tax_id' WHEN 3 THEN 'patient_dob' WHEN 4 THEN 'type_of_bill' WHEN 5 THEN 'patient_control_number' WHEN 6 THEN 'total_charge' ELSE 'remark' END"
_RAW = """CASE o_orderkey % 8 WHEN 0 THEN 'Montgomery-Featherston' || substr(o_orderpriority, 3, 4) || ', Jo' WHEN 1 THEN 'Doe; ' || substr(o_orderpriority, 3) || ' X' WHEN 2 THEN '12-' || CAST(o_custkey + 999000 AS {text}) WHEN 3 THEN CAST(o_custkey % 13 AS {text}) || '/31/2024' WHEN 4 THEN '0' || CAST(o_custkey AS {text}) WHEN 5 THEN o_orderpriority || '#' || CAST(o_orderkey AS {text})
 WHEN 6 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {text}) || CASE WHEN o_custkey % 5 = 0 THEN '-' ELSE '' END ELSE '  ' || o_orderpriority || '  ' END"""


@query(rf"""WITH r AS (SELECT *, {_FIELD} AS field, {_RAW.format(text="VARCHAR")} AS raw, o_orderkey % 8 AS k FROM orders), d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM r),
p AS (SELECT *, 'MONTGOMERY-FEATHERSTON' || upper(rtrim(regexp_replace(substr(o_orderpriority, 3, 4), '[^A-Za-z'' -]', '', 'g'))) AS last, upper(regexp_extract(substr(o_orderpriority, 3), '[A-Za-z]+')) AS first FROM d)
SELECT o_orderkey, field, CASE k WHEN 0 THEN last || ':person_name_component|' || substr(last, 1, 20) || ':person_name_component+fixed_width_output_projection' WHEN 1 THEN first || ':person_name_component' || CASE WHEN length(first) > 9 THEN '|' || substr(first, 1, 9) || ':person_name_component+fixed_width_output_projection' ELSE '' END
 WHEN 2 THEN CASE WHEN length(digits) = 9 THEN digits || ':nine_digit_tax_id' ELSE '' END WHEN 3 THEN CASE WHEN o_custkey % 13 IN (1, 3, 5, 7, 8, 10, 12) THEN digits || ':valid_calendar_date' WHEN try_strptime(digits, '%m%d%Y') IS NOT NULL OR length(digits) = 7 THEN digits || ':valid_calendar_date' ELSE '' END
 WHEN 4 THEN CASE WHEN length(digits) = 4 THEN substr(digits, 2) || ':three_digit_bill_type' WHEN length(digits) = 3 THEN digits || ':three_digit_bill_type' ELSE '' END WHEN 5 THEN regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') || ':identifier_format'
 WHEN 6 THEN CASE WHEN o_custkey % 5 = 0 THEN '' ELSE replace(raw, '$', '') || ':valid_decimal' END ELSE trim(raw) || ':non_empty' END AS readings FROM p""")
def field_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that raw texts of fields may stand for, and by which rule."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_FIELD).alias("field"), F.expr(_RAW.format(text="STRING")).alias("raw"))
    shown = F.transform(readings.field_readings(F.col("field"), F.col("raw")), lambda r: F.concat(r["value"], F.lit(":"), F.array_join(r["tags"], "+")))
    return o.select("o_orderkey", "field", F.array_join(shown, "|").alias("readings"))


_PAIRS = [(c, to) for c, tos in readings.CELL_CONFUSIONS.items() for to in tos]


@query(f"""WITH c AS (SELECT p_partkey, upper(substr(p_type, 1, 2)) || CAST(p_partkey % 1000 AS VARCHAR) AS v FROM part), x AS (SELECT p_partkey, v, i, substr(v, i, 1) AS ch FROM (SELECT *, unnest(range(1, length(v) + 1)) AS i FROM c)), m AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)}) t(ch, other)),
r AS (SELECT p_partkey, v, substr(v, 1, i - 1) || other || substr(v, i + 1) AS value, 'SINGLE_CHARACTER_CONFUSION_' || ch || '_TO_' || other AS method FROM x JOIN m USING (ch) UNION ALL SELECT DISTINCT p_partkey, v, substr(v, 1, i - 1) || substr(v, i + 1), 'SHORT_CODE_SINGLE_NOISE_DELETION' FROM x WHERE length(v) <= 5 AND i > 1 AND i < length(v))
SELECT p_partkey, value, method FROM r""")
def cell_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other readings of codes, for review."""
    cell = F.concat(F.lit(" "), F.substring("p_type", 1, 2), F.lit("-"), (F.col("p_partkey") % 1000).cast("string"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # narrow rows with much work each, however few tasks read them
    return parts.select("p_partkey", F.explode(readings.cell_readings(cell, F.lit("code"))).alias("r")).select("p_partkey", "r.value", "r.method")


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'PO BOX ' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 4 = 1 THEN '' ELSE 'O/' END END AS address, CAST(c_custkey % 90 + 10 AS VARCHAR) AS z, c_custkey % 3 = 0 AS short FROM customer),
b AS (SELECT *, CAST(c_custkey AS VARCHAR) AS n, z || z AS last FROM a), s AS (SELECT *, CASE WHEN length(n) >= 4 AND right(n, 4) = last THEN 4 WHEN length(n) >= 3 AND right(n, 3) = left(last, 3) THEN 3 WHEN length(n) >= 2 AND right(n, 2) = left(last, 2) THEN 2 WHEN right(n, 1) = left(last, 1) THEN 1 ELSE 0 END AS shared FROM b)
SELECT c_custkey, CASE WHEN c_custkey % 4 IN (2, 3) AND NOT short THEN 'PO BOX ' || n || substr(last, shared + 1) ELSE address END AS address FROM s""")
def box_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post office boxes whose number was misread, completed by the postcode."""
    key = F.col("c_custkey")
    n, z = key.cast("string"), (key % 90 + 10).cast("string")
    address = F.when(key % 4 == 0, F.col("c_name")).otherwise(F.concat(F.lit("PO BOX "), n, F.when(key % 4 == 1, "").otherwise("O/")))
    postcode = F.when(key % 3 == 0, "12345").otherwise(F.concat(F.lit("12345-"), z, z))
    return table(spark, sf_dir, "customer").select("c_custkey", readings.box_by_postcode(address, postcode).alias("address"))


_CHECKED = "CASE l_linenumber % 5 WHEN 0 THEN 'revenue_code' WHEN 1 THEN 'charges' WHEN 2 THEN 'diagnosis_pointer' WHEN 3 THEN 'service_units' ELSE 'comment' END"
_WRITTEN = "CASE WHEN l_suppkey % 9 = 0 THEN ' ' WHEN l_linenumber % 5 = 0 THEN CAST(l_partkey AS {text}) || ' ' WHEN l_linenumber % 5 = 1 THEN '(' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {text}) || ')' WHEN l_linenumber % 5 = 2 THEN 'a  ' || CAST(l_partkey % 16 AS {text}) WHEN l_linenumber % 5 = 3 THEN CAST(CAST(l_quantity AS INT) % 9 AS {text}) || '.0' ELSE l_returnflag END"


@query(f"""WITH r AS (SELECT *, {_CHECKED} AS field, {_WRITTEN.format(text="VARCHAR")} AS raw, l_linenumber % 5 AS k, l_returnflag <> 'N' AS agreed, l_linestatus = 'F' AS checked FROM lineitem), c AS (SELECT *, trim(raw) = '' AS empty, CASE k WHEN 0 THEN regexp_full_match(trim(raw), '[0-9]{{4}}') WHEN 1 THEN TRUE WHEN 2 THEN l_partkey % 16 BETWEEN 1 AND 12 WHEN 3 THEN CAST(l_quantity AS INT) % 9 > 0 ELSE FALSE END AS good FROM r),
e AS (SELECT field, CASE WHEN empty THEN checked ELSE good AND agreed END AS valid, CASE WHEN empty AND checked THEN 'INDEPENDENT_BLANK_CONSENSUS' WHEN empty THEN 'INDEPENDENT_BLANK_CONSENSUS_REQUIRED' WHEN NOT agreed THEN 'INDEPENDENT_CONSENSUS_REQUIRED' WHEN k = 0 THEN 'VALID_REVENUE_CODE_FORMAT' WHEN k = 1 THEN 'VALID_AMOUNT' WHEN k = 2 THEN 'VALID_DIAGNOSIS_POINTERS' WHEN k = 3 THEN 'VALID_POSITIVE_UNITS' ELSE 'NO_DETERMINISTIC_RULE' END AS evidence,
 CASE WHEN empty THEN CASE WHEN checked THEN '' END WHEN NOT good THEN NULL WHEN k = 1 THEN '-' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) WHEN k = 2 THEN 'A ' || l_partkey % 16 ELSE trim(raw) END AS value FROM c)
SELECT field, valid, evidence, count(*) AS n, count(DISTINCT value) AS values, min(value) AS least, max(value) AS most FROM e GROUP BY 1, 2, 3""")
def consensus_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of fields that pass their check and that readers agree on, and what the others lack."""
    marks = F.array_compact(F.array(F.when(F.col("l_returnflag") != "N", "CROSS_FAMILY_AGREEMENT"), F.when(F.col("l_linestatus") == "F", "REFERENCE_VERIFIED_BLANK")))
    r = table(spark, sf_dir, "lineitem").select(F.expr(_CHECKED).alias("field"), F.expr(_WRITTEN.format(text="STRING")).alias("raw"), marks.alias("marks"))
    c = r.select("field", readings.accepted_by_consensus(F.col("field"), F.col("raw"), F.col("marks")).alias("c"))
    return c.groupBy("field", "c.valid", "c.evidence").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c.value").alias("values"), F.min("c.value").alias("least"), F.max("c.value").alias("most"))


_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'TYPE_OF_BILL' WHEN 1 THEN 'CURRENCY' WHEN 2 THEN 'PERSON_OR_ORGANIZATION' WHEN 3 THEN 'TAX_IDENTIFIER' WHEN 4 THEN 'ICD_CODE' ELSE 'REMARK' END"
_CANDIDATE = "CASE WHEN p_size % 10 = 0 THEN '  ' WHEN p_partkey % 6 = 0 THEN ' ' || CAST(p_partkey AS {text}) WHEN p_partkey % 6 = 1 THEN CASE WHEN p_size % 3 = 0 THEN '--' ELSE '$' END || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS {text}) WHEN p_partkey % 6 = 2 THEN 'Saint  ' || CASE WHEN p_size % 3 = 0 THEN 'Annclinic' WHEN p_size % 3 = 1 THEN 'MD' ELSE 'clinic' END WHEN p_partkey % 6 = 3 THEN '12-' || CAST(p_partkey + 999000 AS {text}) WHEN p_partkey % 6 = 4 THEN 'j' || CAST(p_partkey % 1000 AS {text}) ELSE p_name END"


@query(f"""WITH r AS (SELECT *, {_KIND} AS kind, {_CANDIDATE.format(text="VARCHAR")} AS raw, p_partkey % 6 AS k FROM part), c AS (SELECT *, trim(raw) = '' AS empty, CASE k WHEN 0 THEN length(trim(raw)) BETWEEN 3 AND 4 WHEN 1 THEN p_size % 3 <> 0 WHEN 2 THEN p_size % 3 = 2 WHEN 3 THEN p_partkey + 999000 BETWEEN 1000000 AND 9999999 WHEN 4 THEN regexp_full_match(upper(raw), 'J[0-9][0-9AB]') ELSE TRUE END AS good FROM r)
SELECT p_partkey, kind, NOT empty AND good AS accepted, CASE WHEN empty THEN NULL WHEN k = 1 THEN CASE WHEN good THEN replace(raw, '$', '') END WHEN k = 2 THEN replace(raw, '  ', ' ') WHEN k = 3 THEN CASE WHEN good THEN replace(raw, '-', '') END WHEN k = 4 THEN upper(raw) ELSE trim(raw) END AS value,
 CASE WHEN empty OR NOT good THEN CASE k WHEN 2 THEN 'PADDLE' WHEN 3 THEN 'TESSERACT' WHEN 4 THEN 'TESSERACT' END END AS second, CASE WHEN empty THEN 'EMPTY_PRIMARY_CANDIDATE,SECONDARY_OCR_SELECTIVE' WHEN good THEN 'RAPID_CANDIDATE_DETERMINISTICALLY_VALID' ELSE 'PRIMARY_VALIDATION_FAILED,SECONDARY_OCR_SELECTIVE' END AS reasons FROM c""")
def local_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local readings that are taken, and the second readers of the others."""
    r = table(spark, sf_dir, "part").select("p_partkey", F.expr(_KIND).alias("kind"), F.expr(_CANDIDATE.format(text="STRING")).alias("raw"))
    c = r.select("p_partkey", "kind", readings.local_candidate(F.col("raw"), F.col("kind")).alias("c"))
    return c.select("p_partkey", "kind", "c.accepted", "c.value", "c.second", F.array_join("c.reasons", ",").alias("reasons"))
