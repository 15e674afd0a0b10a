"""The two standing jobs: files to messages, and messages to the store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.batching import pack_batches
from ..operators.quality import drop_missing_identity
from ..operators.readings import latest_readings, stamp_lineage, upsert_readings
from ..operators.registry import gpu_status, register_gpus, register_hosts
from ..schemas import ATTRIBUTES, DEFAULT_CLUSTER, IDENTITY, METRICS, RECORD_WITH_CUSTOM
from ..sources.csv_files import read_readings_csv, stream_csv_files
from ..sources.messages import encode_messages, parse_messages, records_to_readings, split_decoded, whole_records
from .point_store import append_points
from .sinks import BatchName, SenderTotals, kept, read_batches_of, start_batches, write_batch, write_with_retry


def snapshot_then_tail(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """A parquet folder as a stream: what is there first, then what arrives, nothing missed."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def run_ingest_stream(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, *,
    as_of: datetime | str | None = None, topic: str = "telemetry", ttl_seconds: int = 3600,
    timestamp_mode: str = "event", files_per_trigger: int = 1000, bytes_per_trigger: int | None = None,
    custom_metrics: bool = True, interval: str | None = None, totals: SenderTotals | None = None,
) -> StreamingQuery:
    """Wide and long CSV files to ``out_dir/messages`` and ``out_dir/rejects``.

    Every file is bound by its own header. The driver holds the paths of one
    micro-batch, at most ``files_per_trigger`` or those of ``bytes_per_trigger``.
    Several streams may write to one ``out_dir``. ``as_of`` fixes the clock, for
    tests and replays; otherwise it is the moment the micro-batch starts.
    ``totals`` keeps the running counts of messages, batches and errors.
    """
    arrived = stream_csv_files(
        spark, in_dir, files_per_trigger=files_per_trigger, bytes_per_trigger=bytes_per_trigger
    )

    def handle(batch: DataFrame, name: BatchName) -> None:
        now = as_of or datetime.now().astimezone()
        paths = [row.path for row in batch.collect()]
        if not paths:
            return
        found = read_readings_csv(
            batch.sparkSession, paths, now, timestamp_mode=timestamp_mode, custom_metrics=custom_metrics
        )
        with kept(found) as rows:
            good, rejected = drop_missing_identity(rows)
            messages = encode_messages(good, topic, ttl_seconds, now)
            write_with_retry(rejected, lambda df: write_batch(df, f"{out_dir}/rejects", name))
            write_with_retry(messages, lambda df: write_batch(df, f"{out_dir}/messages", name), totals=totals)
            if totals is not None:
                totals.records += good.count()  # of rows that are kept

    return start_batches(arrived, handle, checkpoint, interval)


def run_collect_stream(
    messages: DataFrame, store: str, checkpoint: str, *, as_of: datetime | str | None = None,
    collector_id: str = "collector", cluster_id: str = DEFAULT_CLUSTER,
    interval: str | None = None, totals: SenderTotals | None = None,
) -> StreamingQuery:
    """Messages to logs below ``store``: points, sightings, newest readings, dead letters.

    Each log has one folder per stream and micro-batch, that of the points with
    folders by cluster and day in it (:mod:`point_store`). The points of the batch
    are written first; what is derived from them reads only the columns it needs
    back. ``totals`` keeps the running counts of records, batches and errors.
    """

    def handle(batch: DataFrame, name: BatchName) -> None:
        spark = batch.sparkSession
        now = as_of or datetime.now().astimezone()
        parsed = parse_messages(batch, RECORD_WITH_CUSTOM)
        with kept(parsed.select("stream_key", "record", "broken")) as records:
            good = whole_records(records, RECORD_WITH_CUSTOM)
            points = stamp_lineage(
                upsert_readings(records_to_readings(good, now, cluster_id), order=("stream_key",)),
                collector_id, now,
            )
            write_with_retry(points, lambda df: append_points(df, store, name), totals=totals)
            if totals is not None:
                totals.records += good.count()  # of records that are kept
            # The rest of a message is read, and its payload parsed again, only where there are malformed ones.
            bad = split_decoded(parsed, RECORD_WITH_CUSTOM)[1]
            if records.filter("broken").isEmpty():
                bad = bad.limit(0)
            write_with_retry(bad, lambda df: write_batch(df, f"{store}/dead_letters", name))
        # Messages without a whole record have left no files, and then no folders to read.
        columns = points.withColumn("event_date", F.to_date("ts")).schema
        stored = spark.read.schema(columns).parquet(f"{store}/points/{name.folder}")
        measured = ("ts", "stream_key", *METRICS)
        seen = stored.groupBy(*IDENTITY, *ATTRIBUTES).agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            F.min("stream_key").alias("stream_key"),
            F.max_by(F.struct(*measured), F.struct("ts", "stream_key")).alias("_newest"),
        )
        with kept(seen) as seen:  # a row for each description of a GPU
            sightings = seen.drop("_newest")
            newest = latest_readings(
                seen.select(*IDENTITY, "_newest.*"), order=("ts", "stream_key"), columns=measured
            )
            write_with_retry(sightings, lambda df: write_batch(df, f"{store}/sightings", name))
            write_with_retry(newest, lambda df: write_batch(df, f"{store}/newest", name))

    return start_batches(messages, handle, checkpoint, interval)


def _sightings(spark: SparkSession, store: str) -> DataFrame:
    log = read_batches_of(spark, f"{store}/sightings")
    return log.select(
        *IDENTITY, *ATTRIBUTES, "stream_key",
        F.explode(F.array("first_ts", "last_ts")).alias("ts"),
    )


def current_hosts(spark: SparkSession, store: str, collector_id: str = "collector") -> DataFrame:
    return register_hosts(_sightings(spark, store), collector_id)


def current_gpus(spark: SparkSession, store: str, collector_id: str = "collector") -> DataFrame:
    """GPUs with their status after all micro-batches so far."""
    gpus = register_gpus(_sightings(spark, store), collector_id, seq="stream_key")
    newest = read_batches_of(spark, f"{store}/newest").withColumnRenamed("stream_key", "seq")
    return gpu_status(gpus, newest)


def batch_stream(
    sdf: DataFrame, by: str, size: int, out_dir: str, checkpoint: str,
    interval: str | None = "10 seconds", seq: str = "seq",
) -> StreamingQuery:
    """Batches of at most ``size`` rows per partition key; each trigger flushes what it has."""
    return start_batches(
        sdf,
        lambda batch, name: write_with_retry(
            pack_batches(batch, by, size, seq), lambda df: write_batch(df, out_dir, name)
        ),
        checkpoint, interval,
    )
