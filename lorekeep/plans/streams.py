"""Queries of the streaming extensions, run as batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as T
from ..streaming import counters
from ..streaming import events as S


def _events(spark, d):
    return T.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


QUERIES = {
    "stream_tumbling": lambda spark, d: S.arrivals(_events(spark, d)),
    "stream_sliding": lambda spark, d: S.arrivals(_events(spark, d), "2 days", "1 day"),
    "stream_sessions": lambda spark, d: S.sessions(_events(spark, d)),
    "stream_receipts": lambda spark, d: S.first_receipts(_events(spark, d).unionByName(_events(spark, d))).select("event_id"),
    "stream_counters_expired": lambda spark, d: counters.expired(_events(spark, d), 8 * 3600, "2024-01-30 12:00:00").select("user_id", "hits", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("since", "until"))),
}

ORACLE = {
    "stream_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT strftime(date_trunc('day', ts) - to_days(k), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) AS v(k) GROUP BY 1, 2",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n_session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, n_session",
    "stream_receipts": "SELECT event_id FROM events",
    "stream_counters_expired": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n_counter FROM g) SELECT user_id, count(*) AS hits, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS until FROM s GROUP BY user_id, n_counter HAVING max(ts) + INTERVAL 8 HOUR < TIMESTAMP '2024-01-30 12:00:00'",
}
