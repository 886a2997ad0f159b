"""Event-time windows with watermarks; one definition serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sentiment(news: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """group_key, start, n, mean of each event-time window."""
    n = news.withWatermark("valid_time", late) if late and news.isStreaming else news
    w = F.window("valid_time", size, slide) if slide else F.window("valid_time", size)
    return n.groupBy(w.alias("w"), "group_key").agg(F.count(F.lit(1)).alias("n"), F.avg("raw_score").alias("mean")).select("group_key", F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    e = events.withWatermark("valid_time", late) if late and events.isStreaming else events
    return e.groupBy(F.session_window("valid_time", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
