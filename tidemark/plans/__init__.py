"""Queries over the driver's tables, each with the SQL that gives the same rows, and the views they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

#: Seconds since 1970 of a time stamp without zone, whatever the session's zone is.
EPOCH = "unix_micros(cast(convert_timezone('UTC', current_timezone(), {}) as timestamp))"


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events as timed tokens: k (user), s and e (micros, lasting 1 to 6 hours), w (type), id, value."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("k"), F.col("event_id").alias("id"), F.expr(EPOCH.format("ts")).alias("s"),
        (F.expr(EPOCH.format("ts")) + (F.col("event_id") % 6 + 1) * 3_600_000_000).alias("e"), F.col("event_type").alias("w"), "value",
    )


#: The same view for DuckDB.
EVENTS = """ev AS (
  SELECT user_id AS k, event_id AS id, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 6 + 1) * 3600000000 AS e, event_type AS w, value FROM events
)"""
