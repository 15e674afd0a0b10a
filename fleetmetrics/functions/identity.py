"""Derived ids, flags and scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the load score.
DEFAULT_WEIGHTS = {"cpu": 0.3, "memory": 0.3, "queue": 0.4}

# Fixed value: the temperature at which a GPU stops being healthy.
HEALTHY_BELOW_CELSIUS = 85.0


def telemetry_id(
    hostname: Column | str = "hostname", gpu_id: Column | str = "gpu_id",
    ts: Column | str = "ts",
) -> Column:
    """``hostname_gpu_unixseconds``: the key under which a point is stored."""
    moment = F.col(ts) if isinstance(ts, str) else ts
    return F.concat_ws("_", hostname, gpu_id, F.unix_seconds(moment.cast("timestamp")))


def gpu_path(cluster: str = "cluster_id", host: str = "hostname", gpu: str = "gpu_id") -> Column:
    """The key of a GPU in the cluster/host/GPU hierarchy."""
    return F.concat(
        F.lit("/telemetry/clusters/"), cluster, F.lit("/hosts/"), host, F.lit("/gpus/"), gpu
    )


def _segment(key: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(key, f"/{name}/([^/]+)", 1), F.lit(""))


def classify_key(key: Column) -> Column:
    """What a hierarchy key names, as struct(kind, cluster, host, gpu, point)."""
    text = F.coalesce(key, F.lit(""))
    is_gpu = text.contains("/gpus/") & ~text.endswith("/") & ~text.endswith("/data")
    kind = (
        F.when(text.contains("/data/"), "data")
        .when(is_gpu, "gpu")
        .when(text.contains("/gpus/"), "other")
        .when(_segment(text, "hosts").isNotNull(), "host")
        .when(_segment(text, "clusters").isNotNull(), "cluster")
        .otherwise("other")
    )
    return F.struct(
        kind.alias("kind"),
        _segment(text, "clusters").alias("cluster"),
        _segment(text, "hosts").alias("host"),
        _segment(text, "gpus").alias("gpu"),
        _segment(text, "data").alias("point"),
    )


def partition_key(by: str) -> Column:
    """The batching key: host name, GPU id, or one constant for any other mode."""
    return F.col(by) if by in ("hostname", "gpu_id") else F.lit("default")


def health_flag(
    temperature: Column | str = "temperature", utilization: Column | str = "gpu_utilization"
) -> Column:
    hot = F.col(temperature) if isinstance(temperature, str) else temperature
    busy = F.col(utilization) if isinstance(utilization, str) else utilization
    return (hot < HEALTHY_BELOW_CELSIUS) & (busy >= 0)


def instance_load(
    weights: Mapping[str, float] | None = None, cpu: str = "cpu_usage",
    memory: str = "memory_usage", queue: str = "queue_depth",
) -> Column:
    """Weighted load of one instance; a queue of 100 or more counts as full."""
    w = {**dict.fromkeys(DEFAULT_WEIGHTS, 0.0), **(DEFAULT_WEIGHTS if weights is None else weights)}
    return (
        F.col(cpu) * w["cpu"]
        + F.col(memory) * w["memory"]
        + F.least(F.col(queue) / 100.0, F.lit(1.0)) * w["queue"]
    )
