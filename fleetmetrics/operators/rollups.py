"""Counts and averages per cluster, host, file and batch; reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import telemetry_id
from ..schemas import IDENTITY
from ..session import instant


def _rows() -> Column:
    return F.count(F.lit(1))


def cluster_metadata(hosts: DataFrame, gpus: DataFrame) -> DataFrame:
    """Per cluster: hosts, GPUs, and how many of each are healthy."""
    by_host = hosts.groupBy("cluster_id").agg(
        F.count_distinct("hostname").alias("total_hosts"),
        F.count_if(F.col("status.healthy")).alias("active_hosts"),
    )
    by_gpu = gpus.groupBy("cluster_id").agg(
        _rows().alias("total_gpus"),
        F.count_if(F.col("status.healthy")).alias("active_gpus"),
    )
    return by_host.join(by_gpu, "cluster_id", "full").select(
        "cluster_id",
        *[
            F.coalesce(c, F.lit(0)).cast("int").alias(c)
            for c in ("total_hosts", "total_gpus", "active_hosts", "active_gpus")
        ],
    )


def cluster_counts(hosts: DataFrame, gpus: DataFrame, cluster: str | None = None) -> DataFrame:
    """Host and GPU count per cluster; an unknown cluster has no row."""
    marked = hosts.select("cluster_id", F.lit(1).alias("h"), F.lit(0).alias("g")).unionByName(
        gpus.select("cluster_id", F.lit(0).alias("h"), F.lit(1).alias("g"))
    )
    if cluster:
        marked = marked.filter(F.col("cluster_id") == cluster)
    return marked.groupBy("cluster_id").agg(
        F.sum("h").alias("host_count"), F.sum("g").alias("gpu_count")
    )


def hosts_with_gpu_count(
    hosts: DataFrame, gpus: DataFrame, cluster: str | None = None
) -> DataFrame:
    """Each host with its number of GPUs, 0 included."""
    if cluster:
        hosts = hosts.filter(F.col("cluster_id") == cluster)
        gpus = gpus.filter(F.col("cluster_id") == cluster)
    key = ["cluster_id", "hostname"]
    counts = gpus.groupBy(*key).agg(_rows().alias("gpu_count"))
    return hosts.join(counts, key, "left").select(
        *key,
        F.col("status.state").alias("status"),
        F.coalesce("gpu_count", F.lit(0)).alias("gpu_count"),
    )


#: The metrics whose means clusters report.
TALLIED = ("gpu_utilization", "memory_utilization")


def reading_tallies(readings: DataFrame, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Per key: rows, sums of the tallied metrics and the last time.

    Tallies of parts of the readings add up to those of the whole
    (:func:`add_tallies`), so that a job can keep them with what it writes.
    """
    return readings.groupBy(*keys).agg(
        _rows().alias("n"),
        *[F.sum(F.col(m).cast("double")).alias(f"sum_{m}") for m in TALLIED],
        *[F.count(m).alias(f"n_{m}") for m in TALLIED],
        F.max("ts").alias("last_ts"),
    )


def add_tallies(tallies: DataFrame, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Tallies of parts, added up per key."""
    counted = ["n", *[f"{kind}_{m}" for kind in ("sum", "n") for m in TALLIED]]
    return tallies.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counted], F.max("last_ts").alias("last_ts"))


def stats_of_tallies(tallies: DataFrame, hosts: DataFrame, gpus: DataFrame) -> DataFrame:
    """:func:`cluster_stats` from tallies, whatever parts they are of."""
    mean = lambda m: F.coalesce(F.try_divide(f"sum_{m}", f"n_{m}"), F.lit(0.0))
    return (
        cluster_metadata(hosts, gpus)
        .join(add_tallies(tallies), "cluster_id", "left")
        .select(
            "cluster_id", "total_hosts", "total_gpus",
            F.col("active_gpus"),
            F.coalesce("n", F.lit(0)).alias("telemetry_records"),
            mean("gpu_utilization").alias("average_gpu_util"),
            mean("memory_utilization").alias("average_memory_util"),
            F.col("last_ts").alias("last_updated"),
        )
    )


def cluster_stats(readings: DataFrame, hosts: DataFrame, gpus: DataFrame) -> DataFrame:
    """Per cluster: hosts, GPUs, healthy GPUs, readings, mean utilisation, last update."""
    return stats_of_tallies(reading_tallies(readings), hosts, gpus)


def ingest_stats(
    good: DataFrame, rejected: DataFrame, seconds: float | None = None
) -> DataFrame:
    """Per file: processed, skipped and all rows, and rows per second of the run."""
    marked = good.select("source_file", F.lit(1).alias("ok")).unionByName(
        rejected.select("source_file", F.lit(0).alias("ok"))
    )
    out = marked.groupBy("source_file").agg(
        F.sum("ok").alias("processed"),
        _rows().alias("total"),
        (_rows() - F.sum("ok")).alias("skipped"),
    )
    rate = F.try_divide(F.col("processed"), F.lit(float(seconds))) if seconds else F.lit(None)
    return out.withColumn("records_per_second", F.round(rate.cast("double"), 2))


def reconcile_counts(source: DataFrame, sink: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected and stored rows per key, the percentage cut to 2 decimals, and a status."""
    marked = source.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("s")).unionByName(
        sink.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("s"))
    )
    counted = marked.groupBy(*keys).agg(
        F.sum("e").alias("expected"), F.sum("s").alias("stored")
    )
    percent = F.try_divide(F.floor(F.try_divide(F.col("stored") * 10000, "expected")), F.lit(100))
    return counted.withColumn(
        "percent", F.coalesce(percent.cast("double"), F.lit(0.0))
    ).withColumn(
        "status",
        F.when(F.col("stored") == 0, "none")
        .when(F.col("stored") == F.col("expected"), "complete")
        .otherwise("partial"),
    )


def missing_readings(source: DataFrame, sink: DataFrame) -> DataFrame:
    """Source rows whose storage key (cluster, host, GPU, second) never arrived."""
    keys = [*IDENTITY, "telemetry_id"]
    arrived = sink.withColumn("telemetry_id", telemetry_id()).select(*keys).distinct()
    return source.withColumn("telemetry_id", telemetry_id()).join(arrived, keys, "left_anti")


def sender_metrics(
    batches: DataFrame, started_at: datetime | str, as_of: datetime | str
) -> DataFrame:
    """Totals over sent batches (columns ``n``, ``ok``, ``sent_at``) and rows per second."""
    elapsed = F.unix_micros(instant(as_of)) - F.unix_micros(instant(started_at))
    processed = F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0))
    return batches.agg(
        processed.alias("total_processed"),
        F.count_if("ok").alias("total_batches"),
        F.count_if(~F.col("ok")).alias("total_errors"),
        F.max("sent_at").alias("last_process_time"),
        F.try_divide(processed.cast("double") * 1_000_000, elapsed).alias("processing_rate"),
    )
