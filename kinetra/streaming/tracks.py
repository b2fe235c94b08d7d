"""Tracked readings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_motion(readings: DataFrame, value: str, window: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Per session and window of event time: readings, mean, least and most of ``value``.

    ``readings``: a stream with reading_id, session_id, utc_epoch_ms and the value. Deliveries of one id within the lateness
    count once; readings later than that are dropped; null and NaN values count as readings only.
    """
    timed = readings.withColumn("at", F.timestamp_millis("utc_epoch_ms")).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["reading_id"])
    known = F.when(~F.isnan(value), F.col(value))
    return timed.groupBy("session_id", F.window("at", window).alias("w")).agg(F.count("*").alias("readings"), F.avg(known).alias("mean"), F.min(known).alias("low"), F.max(known).alias("high")).select("session_id", F.col("w.start").alias("from_at"), "readings", "mean", "low", "high")


def stretches(readings: DataFrame, gap: str = "2 seconds", lateness: str = "1 minute") -> DataFrame:
    """Per session the stretches of readings without a gap, once no late reading can extend them: from, to, readings."""
    timed = readings.withColumn("at", F.timestamp_millis("utc_epoch_ms")).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["reading_id"])
    return timed.groupBy("session_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("readings")).select("session_id", F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "readings")
