"""Incremental forms of the flow and profile operators for Structured Streaming.

Each function takes a streaming (or static) frame; watermarks are parameters because the data decide
how late an event may be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_totals(flows: DataFrame) -> DataFrame:
    """Running totals per pair; write in update or complete mode."""
    return flows.groupBy("from_id", "to_id").agg(F.sum("energy_kwh").alias("energy_kwh"), F.count("*").alias("n"))


def hourly_energy(states: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Hourly demand per building in append mode: a window is final once the watermark passes it."""
    w = F.window("ts", "1 hour")
    s = states.withWatermark("ts", watermark) if states.isStreaming else states
    return s.groupBy(w, "building_id").agg(F.sum("demand").alias("demand"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "building_id", "demand", "n")


def metric_windows(metrics: DataFrame, every: str, slide: str | None = None, watermark: str = "10 minutes", name: str = "event_type", value: str = "demand") -> DataFrame:
    m = metrics.withWatermark("ts", watermark) if metrics.isStreaming else metrics
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    return m.groupBy(w, name).agg(F.avg(value).alias("mean"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), name, "mean", "max")


def alerts(windows: DataFrame, limit: float) -> DataFrame:
    return windows.where(F.col("max") > limit)


def deduplicated(states: DataFrame, key: str, watermark: str = "1 hour") -> DataFrame:
    """One row per key: within the watermark on a stream, over all rows of a table."""
    return states.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key]) if states.isStreaming else states.dropDuplicates([key])


def retained(states: DataFrame, days: int, now: str) -> DataFrame:
    return states.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
