"""Streaming jobs run over the whole event table, beside what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..sources.tables import table
from ..streaming import governor, jobs
from .base import Catalogue

catalogue = Catalogue()
query = catalogue.query


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.event_stream(spark, f"{sf_dir}/events.parquet")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type."""
    out = jobs.event_windows(_stream(spark, sf_dir), "1 hour", "2 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events delivered twice, each kept once."""
    twice = _stream(spark, sf_dir).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    return jobs.without_replays(twice, "event_id", "30 days").select("event_id", "user_id", "event_type")


@query("""SELECT user_id AS key, 'claims.events' AS topic, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM events""")
def outbox_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox published in order for each key."""
    return jobs.outbox_relay(_stream(spark, sf_dir), "claims.events").select("key", "topic", "event_id", "place")


@query("""SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'UNPARSEABLE' ELSE 'REJECTED' END AS reason FROM events WHERE event_id % 97 = 0 OR value > 50""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that can't be parsed, every 97th being broken first, or are beyond the limit."""
    broken = _stream(spark, sf_dir).withColumn("props", F.when(F.col("event_id") % 97 == 0, "{broken").otherwise(F.col("props")))
    return jobs.split_dead_letters(broken, "k int", "value > 50")[1].select("event_id", "reason")


@query("""WITH RECURSIVE o AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, day, event_id, k, value <= 40 AS granted, CASE WHEN value <= 40 THEN 0.0::DOUBLE + value ELSE 0.0::DOUBLE END AS spent FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.day, o.event_id, o.k, g.spent + o.value <= 40, CASE WHEN g.spent + o.value <= 40 THEN g.spent + o.value ELSE g.spent END FROM g JOIN o ON o.user_id = g.user_id AND o.day = g.day AND o.k = g.k + 1)
SELECT user_id, event_id, granted FROM g""")
def rate_window_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests granted within each user's daily budget, by state."""
    return jobs.spend_within_budget(_stream(spark, sf_dir), 40.0)


_LIMITS = governor.Limits({"TEXT": 3, "CROP": 2}, 6.0, 1.5, 0.5)


@query("""WITH RECURSIVE e AS (SELECT user_id % 20 AS account, event_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY date_trunc('milliseconds', ts), event_id) AS k, event_type = 'view' AS is_page, user_id || '/' || event_id % 4 AS page, user_id % 60 || '' AS claim, CASE WHEN event_type = 'purchase' THEN 'CROP' ELSE 'TEXT' END AS tier, value / 20 AS cost FROM events),
g AS (SELECT DISTINCT account, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, false AS is_page, CAST(NULL AS VARCHAR) AS why, CAST(MAP {} AS MAP(VARCHAR, INTEGER)) AS calls, CAST(MAP {} AS MAP(VARCHAR, DOUBLE)) AS costs, CAST(0 AS BIGINT) AS pages, CAST(0 AS DOUBLE) AS total FROM e
 UNION ALL SELECT account, k, event_id, is_page, why, CASE WHEN why = 'AUTHORIZED' THEN map_concat(calls, MAP {key: coalesce(calls[key], 0) + 1}) ELSE calls END, CASE WHEN why = 'AUTHORIZED' THEN map_concat(costs, MAP {claim: coalesce(costs[claim], 0) + cost}) ELSE costs END, pages + CAST(is_page AS BIGINT), CASE WHEN why = 'AUTHORIZED' THEN total + cost ELSE total END
 FROM (SELECT g.account, e.k, e.event_id, e.is_page, calls, costs, pages, total, page || tier AS key, claim, cost, CASE WHEN e.is_page THEN '' WHEN coalesce(calls[page || tier], 0) >= CASE WHEN tier = 'TEXT' THEN 3 ELSE 2 END THEN 'PAGE_CALL_LIMIT' WHEN coalesce(costs[claim], 0) + 0.5 > 6 THEN 'CLAIM_COST_LIMIT' WHEN (total + 0.5) / greatest(1, pages) > 1.5 THEN 'MEAN_COST_LIMIT' ELSE 'AUTHORIZED' END AS why
  FROM g JOIN e ON e.account = g.account AND e.k = g.k + 1))
SELECT account, event_id, why = 'AUTHORIZED' AS granted, why AS reason FROM g WHERE NOT is_page AND event_id IS NOT NULL""")
def governed_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls granted within the limits of their page, claim and account, in order of time, by state; times count to the millisecond, as watermarks do."""
    kind, tier = F.when(F.col("event_type") == "view", "PAGE").otherwise("CALL"), F.when(F.col("event_type") == "purchase", "CROP").otherwise("TEXT")
    events = _stream(spark, sf_dir).select(
        (F.col("user_id") % 20).alias("account"), "event_id", F.date_trunc("millisecond", "ts").alias("ts"), kind.alias("kind"), F.concat_ws("/", "user_id", (F.col("event_id") % 4).cast("string")).alias("page"), (F.col("user_id") % 60).cast("string").alias("claim"), tier.alias("tier"), (F.col("value") / 20).alias("cost")
    )
    return governor.governed_calls(events, _LIMITS, "0 seconds")


@query("""WITH s AS (SELECT event_type AS segment, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 30) AS high FROM events GROUP BY 1)
SELECT '1998-W52' AS as_of_week, segment, n, users, concat_ws(',', CASE WHEN NOT n >= 1900 THEN 'ENOUGH' END, CASE WHEN NOT CAST(high AS DOUBLE) / n <= 0.05 THEN 'HIGH_VALUES' END) AS failed, sha256(concat_ws('|', '1998-W52', segment, n, users, high)) AS content_hash FROM s""")
def ledger_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly report over the whole ledger: sums, failed gates and a digest of the content."""
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 30).alias("high"))
    gates = {"enough": F.col("n") >= 1900, "high_values": F.col("high").cast("double") / F.col("n") <= 0.05}
    digest = F.sha2(F.concat_ws("|", F.lit("1998-W52"), "segment", F.col("n").cast("string"), F.col("users").cast("string"), F.col("high").cast("string")), 256)
    return s.select(F.lit("1998-W52").alias("as_of_week"), "segment", "n", "users", rules.failed_gates(gates).alias("failed"), digest.alias("content_hash"))
