"""Windowed aggregations over streams of timed events, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """Time stamps without a zone count as the session's zone; a watermark needs a zoned one."""
    return events.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)


def gap_sessions(events: DataFrame, keys: list[str], at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of the pure gap rule: start, end and number of events; rows later than the watermark are dropped."""
    w = F.session_window("_t", gap)
    return _timed(events, at, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, "w.start", "w.end", "n")


def tumbling_counts(events: DataFrame, keys: list[str], at: str, width: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts in tumbling windows, or sliding ones with ``slide``."""
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    return _timed(events, at, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, "w.start", "w.end", "n")


def first_arrivals(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark's time."""
    return _timed(events, at, late).dropDuplicatesWithinWatermark(keys).drop("_t")
