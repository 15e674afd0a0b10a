"""Built-in stateful operators: first sightings, newest status, sessions, time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.readings import latest_readings
from ..operators.services import DEFAULT_TTL_SECONDS
from ..schemas import IDENTITY

DEFAULT_DELAY = "10 minutes"


def _watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def dedup_stream(
    sdf: DataFrame, keys: Sequence[str], delay: str | None = None, ts: str = "ts"
) -> DataFrame:
    """The first row seen per key. State is one entry per key, or, with ``delay``,
    per key seen within that time."""
    if delay is None:
        return sdf.dropDuplicates(list(keys))
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def latest_status_stream(
    sdf: DataFrame, keys: Sequence[str] = IDENTITY, order: Sequence[str] = ("ts", "seq")
) -> DataFrame:
    """The newest row per key, for output mode ``update``: every change is emitted."""
    return latest_readings(sdf, keys, order)


def windowed_utilisation(
    df: DataFrame, window: str = "5 minutes", slide: str | None = None,
    delay: str = DEFAULT_DELAY, ts: str = "ts",
) -> DataFrame:
    """Mean and greatest utilisation and temperature per GPU and time window."""
    as_double = lambda c: F.col(c).cast("double")
    return (
        _watermarked(df, ts, delay)
        .groupBy(*IDENTITY, F.window(ts, window, slide))
        .agg(
            F.count(F.lit(1)).alias("readings"),
            F.avg(as_double("gpu_utilization")).alias("avg_gpu_utilization"),
            F.max("gpu_utilization").alias("max_gpu_utilization"),
            F.avg(as_double("memory_utilization")).alias("avg_memory_utilization"),
            F.max("memory_utilization").alias("max_memory_utilization"),
            F.max("temperature").alias("max_temperature"),
        )
        .select(
            *IDENTITY,
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "readings", "avg_gpu_utilization", "max_gpu_utilization",
            "avg_memory_utilization", "max_memory_utilization", "max_temperature",
        )
    )


def liveness_stream(
    sdf: DataFrame, ttl_seconds: int = DEFAULT_TTL_SECONDS, delay: str = "0 seconds",
    ts: str = "ts",
) -> DataFrame:
    """Each stretch of time an instance was up, emitted once it is known to be over.

    An instance is up from a heartbeat until its TTL passes without another one.
    """
    up = F.session_window(ts, f"{ttl_seconds} seconds")
    health = F.coalesce(F.nullif(F.col("health"), F.lit("")), F.lit("healthy"))
    return (
        _watermarked(sdf, ts, delay)
        .groupBy("service_type", "instance_id", up.alias("_up"))
        .agg(
            F.max_by(health, ts).alias("health"),
            F.count(F.lit(1)).alias("heartbeats"),
        )
        .select(
            "service_type", "instance_id",
            F.col("_up.start").alias("up_from"), F.col("_up.end").alias("down_at"),
            "health", "heartbeats",
        )
    )
