"""Risk tables kept up by a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.running import running, total


def stream_counts(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Streaming state: events and exits per distinct time. State grows with distinct times, not with rows."""
    return obs.groupBy(*by, "x").agg(F.sum(F.when(F.col("c") == 0, F.col("n")).otherwise(0.0)).alias("d"), F.sum("n").alias("out"))


def risk_from_counts(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, r, d) of the counts that a stream has written."""
    return running(counts, by, "x", {"r": total(F.col("out"))}, descending=True).select(*by, "x", "r", "d")


def windowed_events(events: DataFrame, time: str, width: str, late: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Events per window of event time, with a watermark for late rows: the increments of a cumulative count."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *by).agg(F.count("*").alias("n"))
