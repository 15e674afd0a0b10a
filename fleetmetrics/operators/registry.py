"""Clusters, hosts and GPUs as seen in the readings, with their present state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import gpu_path, health_flag
from ..schemas import ATTRIBUTES, IDENTITY, METRICS
from ..session import shared_dir
from .readings import latest_readings, one_number


def _labels(collector_id: str):
    return F.create_map(
        F.lit("collector_id"), F.lit(collector_id), F.lit("registered_by"), F.lit("fleetmetrics")
    )


#: What a GPU's status is made of.
STATUS_METRICS = ("gpu_utilization", "memory_utilization", "temperature", "power_draw")


def condense(
    df: DataFrame, name: str = "sightings", measured: Sequence[str] = METRICS
) -> DataFrame:
    """What the registry needs of readings, written once: a GPU's first and newest sighting by description.

    One hashing pass over the readings; hosts, GPUs and their status come out
    the same from this table as from the readings. It has two rows for each
    description that a GPU ever had, and lies below ``spark.checkpoint.dir``.
    ``measured`` names the metrics to keep: ``STATUS_METRICS`` for the status,
    none where only names are wanted, which then cost nothing to read.
    """
    number = one_number(df, ("ts", "seq"))
    if number is None:
        raise ValueError("readings need a time ts and a whole number seq")
    measured = [c for c in measured if c in df.columns]
    newest = df.groupBy(*IDENTITY, *ATTRIBUTES).agg(
        F.min("ts").alias("_from"), F.min("seq").alias("_first"),
        *[F.max_by(c, number).alias(f"_{c}") for c in ("ts", "seq")],
        *[F.max_by(c, number).alias(c) for c in measured],
    )
    moments = F.array(
        F.struct(F.col("_from").alias("ts"), F.col("_first").alias("seq")),
        F.struct(F.col("_ts").alias("ts"), F.col("_seq").alias("seq")),
    )
    rows = newest.select(*IDENTITY, *ATTRIBUTES, F.inline(moments), *measured)
    path = shared_dir(df.sparkSession, name)
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def register_hosts(df: DataFrame, collector_id: str = "collector") -> DataFrame:
    """One row per cluster and host, from its first sighting on."""
    seen = df.groupBy("cluster_id", "hostname").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_seen")
    )
    return seen.select(
        "cluster_id",
        F.col("hostname").alias("host_id"),
        "hostname",
        F.lit("unknown").alias("ip_address"),
        F.lit("unknown").alias("os_version"),
        _labels(collector_id).alias("labels"),
        "created_at",
        F.col("last_seen").alias("updated_at"),
        F.struct(
            F.lit("active").alias("state"),
            F.lit(True).alias("healthy"),
            F.col("last_seen"),
            F.create_map(F.lit("ping"), F.lit("ok")).alias("health_checks"),
        ).alias("status"),
    )


def register_gpus(
    df: DataFrame, collector_id: str = "collector", seq: str = "seq"
) -> DataFrame:
    """One row per GPU; its first sighting fixes UUID, device and model.

    The readings are first reduced to the few distinct descriptions each GPU
    ever had, by hashing; only those are then compared.
    """
    order = seq if seq in df.columns else "ts"
    descriptions = df.groupBy(*IDENTITY, *ATTRIBUTES).agg(
        F.min(order).alias("_first"), F.min("ts").alias("_from"), F.max("ts").alias("_to")
    )
    first = descriptions.groupBy(*IDENTITY).agg(
        F.min(F.struct("_first", *ATTRIBUTES)).alias("_d"),
        F.min("_from").alias("created_at"),
        F.max("_to").alias("updated_at"),
    )
    return first.select(
        *IDENTITY,
        F.col("_d.uuid").alias("uuid"),
        F.col("_d.device").alias("device"),
        F.col("_d.model_name").alias("device_name"),
        F.lit("unknown").alias("driver_version"),
        F.lit("unknown").alias("cuda_version"),
        F.lit(0).alias("memory_total_mb"),
        _labels(collector_id).alias("properties"),
        "created_at",
        "updated_at",
    )


def gpu_status(gpus: DataFrame, readings: DataFrame) -> DataFrame:
    """Each GPU with its state after its newest reading.

    A GPU without readings is active and healthy with zeros.
    """
    newest = latest_readings(readings, columns=("ts", *STATUS_METRICS)).withColumnRenamed("ts", "_ts")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0).cast("float"))
    status = F.struct(
        F.lit("active").alias("state"),
        zero("gpu_utilization").alias("utilization_percent"),
        zero("memory_utilization").alias("memory_used_percent"),
        zero("temperature").alias("temperature_celsius"),
        zero("power_draw").alias("power_draw_watts"),
        F.coalesce(health_flag(), F.lit(True)).alias("healthy"),
        F.coalesce("_ts", "created_at").alias("last_updated"),
    )
    return gpus.join(newest, list(IDENTITY), "left").select(
        *[gpus[c] for c in gpus.columns], status.alias("status")
    )


def list_gpus(gpus: DataFrame, cluster: str | None = None) -> DataFrame:
    """GPUs, one per UUID (or host and id where it has none); the last by key wins."""
    if cluster:
        gpus = gpus.filter(F.col("cluster_id") == cluster)
    state = F.col("status.state") if "status" in gpus.columns else F.lit("active")
    unique = F.coalesce(F.nullif(F.col("uuid"), F.lit("")), F.concat_ws(":", "hostname", "gpu_id"))
    listed = F.struct(
        F.col("gpu_id").alias("id"), "uuid", "hostname", F.col("device_name").alias("name"),
        "device", state.alias("status"),
    )
    return (
        gpus.groupBy(unique.alias("_unique"))
        .agg(F.max_by(listed, gpu_path()).alias("_gpu"))
        .select("_gpu.*")
    )


def list_clusters(clusters: DataFrame, counts: DataFrame) -> DataFrame:
    """Every known cluster with its host and GPU counts (see ``cluster_counts``)."""
    known = clusters.select("cluster_id").distinct()
    return known.join(counts, "cluster_id", "left").select(
        F.col("cluster_id").alias("id"),
        F.col("cluster_id").alias("name"),
        F.lit("active").alias("status"),
        F.coalesce("host_count", F.lit(0)).alias("host_count"),
        F.coalesce("gpu_count", F.lit(0)).alias("gpu_count"),
    )


def list_hosts(hosts: DataFrame, cluster: str | None = None) -> DataFrame:
    if cluster:
        hosts = hosts.filter(F.col("cluster_id") == cluster)
    return hosts.select("hostname").distinct()


def list_gpus_of_host(gpus: DataFrame, host: str, cluster: str | None = None) -> DataFrame:
    found = gpus.filter(F.col("hostname") == host)
    return found.filter(F.col("cluster_id") == cluster) if cluster else found


def get_cluster(clusters: DataFrame, cluster: str) -> DataFrame:
    """The cluster's row; no row means not found."""
    return clusters.filter(F.col("cluster_id") == cluster)


def get_host(hosts: DataFrame, cluster: str, host: str) -> DataFrame:
    return hosts.filter((F.col("cluster_id") == cluster) & (F.col("hostname") == host))


def get_gpu(gpus: DataFrame, cluster: str, host: str, gpu: str) -> DataFrame:
    return gpus.filter(
        (F.col("cluster_id") == cluster) & (F.col("hostname") == host) & (F.col("gpu_id") == gpu)
    )


def fleet_tree(
    hosts: DataFrame, gpus: DataFrame, metadata: DataFrame, parts: int = 1
) -> DataFrame:
    """Cluster, host and GPUs nested: one row per host with its cluster and GPU array.

    ``gpus`` are those of ``gpu_status``, ``metadata`` that of
    ``cluster_metadata``. With ``parts`` above 1 every host's GPUs are spread
    over as many rows by the hash of their id, numbered by ``part``; the first
    part is there for every host, the others where they hold a GPU.
    """
    host = ["cluster_id", "hostname"]
    node = F.struct("gpu_id", "uuid", "device", "device_name", "status")
    arrays = (
        gpus.select(
            *host, F.pmod(F.xxhash64("gpu_id"), F.lit(parts)).alias("part"), node.alias("_gpu")
        )
        .groupBy(*host, "part")
        .agg(F.sort_array(F.collect_list("_gpu")).alias("gpus"))
    )
    if parts > 1:
        every = hosts.select(*host, F.lit(0).cast("long").alias("part")).unionByName(arrays.select(*host, "part"))
        arrays = every.distinct().join(arrays, [*host, "part"], "left")
    empty = F.array().cast(arrays.schema["gpus"].dataType)
    return (
        hosts.select(*host, F.col("status.state").alias("_state"))
        .join(arrays, host, "left")
        .join(metadata.select("cluster_id", "total_hosts", "total_gpus"), "cluster_id", "left")
        .select(
            F.struct("cluster_id", "total_hosts", "total_gpus").alias("cluster"),
            F.struct("hostname", F.col("_state").alias("state")).alias("host"),
            F.coalesce("part", F.lit(0)).cast("long").alias("part"),
            F.coalesce("gpus", empty).alias("gpus"),
        )
    )
