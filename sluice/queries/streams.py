"""Event-time windows over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.core.session import table
from sluice.queries import query
from sluice.streaming import heartbeats as H
from sluice.streaming import windows as W


def _plain(df):
    return df.select("key", F.col("begins").cast("timestamp_ntz").alias("begins"), F.col("ends").cast("timestamp_ntz").alias("ends"), "n", F.round("total", 4).alias("total"))


_TUMBLING = "SELECT event_type AS key, time_bucket(INTERVAL 1 HOUR, ts) AS begins, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ends, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query(_TUMBLING)
def tumbling_events(spark, sf_dir):
    return _plain(W.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour"))


@query("SELECT event_type AS key, b AS begins, b + INTERVAL 2 HOUR AS ends, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY 1, 2")
def sliding_events(spark, sf_dir):
    return _plain(W.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value", "2 hours", "1 hour"))


@query(f"SELECT * FROM ({_TUMBLING}) WHERE ends <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_tumbling_events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return _plain(W.stream_windows(spark, sf_dir, "events.parquet", schema, "ts", "event_type", "value", "1 hour", "10 minutes"))


@query("""
WITH e AS (SELECT (event_id * 7919) % 100003 AS arrival, event_id, CAST(epoch(ts) AS BIGINT) // 60 + (event_id * 31) % 90 AS s FROM events), o AS (SELECT event_id + arrival % 40 AS place, event_id, s FROM e),
m AS (SELECT s, max(s) OVER (ORDER BY place * 1000000 + event_id ROWS UNBOUNDED PRECEDING) - 30 AS mark FROM o)
SELECT count(*) AS events, count(*) FILTER ((s // 60) * 60 + 60 > mark) AS windowed, count(*) FILTER ((s // 60) * 60 + 60 <= mark) AS late FROM m
""")
def late_event_accounting(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    arrival = (F.col("event_id") + ((F.col("event_id") * 7919) % 100003) % 40) * 1000000 + F.col("event_id")
    minutes = F.floor(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 60) + (F.col("event_id") * 31) % 90
    return W.late_accounting(e.select(arrival.alias("arrival"), minutes.alias("s")), "arrival", "s", 60, 60, 30)


@query("""
WITH l AS (SELECT user_id AS job, max(ts) AS last FROM events GROUP BY 1)
SELECT job, last, date_trunc('second', last) + INTERVAL 1 SECOND * (3600 * (job % 48) + 600) AS deadline FROM l WHERE date_trunc('second', last) + INTERVAL 1 SECOND * (3600 * (job % 48) + 600) < TIMESTAMP '2024-01-31'
""")
def heartbeat_overdue(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("user_id").alias("job")).distinct().select("job", (F.col("job") % 48 * 3600).alias("interval"), F.lit(600).alias("grace"))
    out = W.overdue(e, jobs, "user_id", "ts", "2024-01-31")
    return out.select("job", F.col("last").cast("timestamp_ntz").alias("last"), F.col("deadline").cast("timestamp_ntz").alias("deadline"))


@query("""
WITH p AS (SELECT DISTINCT user_id AS job, ts, 3600 * (12 + user_id % 36) AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT job, ts AS last, ts + INTERVAL 1 SECOND * s AS deadline, lead(ts) OVER (PARTITION BY job ORDER BY ts) AS next FROM p)
SELECT job, last, deadline FROM g WHERE (next IS NULL OR next > deadline) AND deadline <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)
""")
def stream_heartbeat_gaps(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    limit = (F.lit(12) + F.col("user_id") % 36) * 3600
    out = H.run_silences(spark, sf_dir, schema, "user_id", "ts", limit, "10 minutes", "events.parquet")
    return out.select("job", F.col("last").cast("timestamp_ntz").alias("last"), F.col("deadline").cast("timestamp_ntz").alias("deadline"))
