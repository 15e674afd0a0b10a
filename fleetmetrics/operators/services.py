"""Service instances by their heartbeats."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import instant_for, utc

# Fixed value: lifetime of a registration without a new heartbeat.
DEFAULT_TTL_SECONDS = 30


def live_services(
    heartbeats: DataFrame, as_of: datetime | str, ttl_seconds: float = DEFAULT_TTL_SECONDS,
    service_type: str | None = None,
) -> DataFrame:
    """Instances whose last heartbeat is younger than the TTL, with their latest health.

    Older heartbeats cannot matter and are cut off at the reader.
    """
    oldest = utc(as_of) - timedelta(seconds=ttl_seconds)
    recent = heartbeats.filter(
        (F.col("ts") > instant_for(heartbeats, "ts", oldest))
        & (F.col("ts") <= instant_for(heartbeats, "ts", as_of))
    )
    if service_type:
        recent = recent.filter(F.col("service_type") == service_type)
    keys = ("service_type", "instance_id")
    rest = [c for c in heartbeats.columns if c not in keys]
    order = F.struct(*[c for c in ("ts", "seq") if c in rest])
    return (
        recent.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, "_row.*")
        .withColumn("health", F.coalesce(F.nullif(F.col("health"), F.lit("")), F.lit("healthy")))
    )
