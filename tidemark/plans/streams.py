"""Streams over the test tables, run to their ends; the SQL says what the same rows are in a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import EPOCH
from tidemark.plans.changes import arrivals, outcomes_sql
from tidemark.registry import query
from tidemark.sources.tables import new_dir
from tidemark.streaming import inbox, windows
from tidemark.streaming.runs import finished, stream_of


@query("stream_idempotent_apply", outcomes_sql())
def stream_idempotent_apply(spark, d):
    accepted, outcomes = new_dir(spark, "accepted"), new_dir(spark, "outcomes")
    inbox.apply_stream(arrivals(stream_of(spark, d, "events")), accepted, outcomes, new_dir(spark, "inbox-checkpoint")).awaitTermination()
    return spark.read.schema("seq bigint, event_id string, outcome string").parquet(outcomes).select("seq", "event_id", "outcome")


def _micros(column: str):
    return F.unix_micros(column).alias(column)


@query("stream_tumbling_counts", """
SELECT event_type, epoch_us(ts) // 3600000000 * 3600000000 AS start, count(*) AS n FROM events GROUP BY ALL""")
def stream_tumbling_counts(spark, d):
    events = stream_of(spark, d, "events").withColumn("at", F.timestamp_micros(F.expr(EPOCH.format("ts"))))
    out = finished(windows.tumbling_counts(events, ["event_type"], "at", "1 hour"), "complete")
    return out.select("event_type", _micros("start"), "n")


@query("stream_gap_sessions", """
WITH g AS (SELECT user_id, epoch_us(ts) AS s, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000000 THEN 1 ELSE 0 END AS b FROM events
), n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s) AS i FROM g)
SELECT user_id, min(s) AS start, max(s) + 3600000000 AS "end", count(*) AS n FROM n GROUP BY user_id, i""")
def stream_gap_sessions(spark, d):
    events = stream_of(spark, d, "events").withColumn("at", F.timestamp_micros(F.expr(EPOCH.format("ts"))))
    out = finished(windows.gap_sessions(events, ["user_id"], "at", "1 hour"), "complete")
    return out.select("user_id", _micros("start"), _micros("end"), "n")
