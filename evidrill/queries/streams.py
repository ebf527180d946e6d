"""Relay and event-time queries, run on the whole tables as batches; the same functions take streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.queries import views as V
from evidrill.streaming import events as S


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("turns"))


def relay_events(spark: SparkSession, sf: str) -> DataFrame:
    return S.relay_events(_requests(spark, sf), F.col("turns") % 5 == 0, F.col("turns") % 7 == 0)


RELAY_EVENTS = """WITH r AS (SELECT conv_id AS session_id, max(turn) AS turns FROM conversations GROUP BY 1), e AS (
SELECT session_id, unnest(CASE WHEN turns % 7 = 0 THEN ['start', 'error'] WHEN turns % 5 = 0 THEN ['start', 'auditor', 'done'] ELSE ['start', 'router', 'retriever', 'generator', 'auditor', 'done'] END) AS x, unnest(range(6)) AS i FROM r)
SELECT session_id, CAST(i AS INTEGER) AS seq, CASE WHEN x IN ('start', 'error', 'done') THEN x ELSE 'node_update' END AS type, CASE WHEN x IN ('start', 'error', 'done') THEN NULL ELSE x END AS node FROM e WHERE x IS NOT NULL"""


def session_states(spark: SparkSession, sf: str) -> DataFrame:
    return S.session_state(relay_events(spark, sf))


SESSION_STATES = "SELECT session_id, CAST(CASE WHEN turns % 7 = 0 THEN 0 WHEN turns % 5 = 0 THEN 1 ELSE 4 END AS BIGINT) AS updates, CASE WHEN turns % 7 = 0 THEN 'error' ELSE 'done' END AS state FROM (SELECT conv_id AS session_id, max(turn) AS turns FROM conversations GROUP BY 1)"


def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = S.tumbling_counts(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


TUMBLING_COUNTS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = S.sliding_counts(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


SLIDING_COUNTS = "SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d, event_type FROM events) GROUP BY ALL"


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = S.sessions(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


USER_SESSIONS = """WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT user_id, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id"""

QUERIES = {
    "relay_events": (relay_events, RELAY_EVENTS),
    "session_states": (session_states, SESSION_STATES),
    "tumbling_counts": (tumbling_counts, TUMBLING_COUNTS),
    "sliding_counts": (sliding_counts, SLIDING_COUNTS),
    "user_sessions": (user_sessions, USER_SESSIONS),
}
