"""Session settings, the shared work folder, and time literals."""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Column call sites in error messages cost half the time it takes to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; extra settings win."""
    builder = SparkSession.builder.appName("fleetmetrics")
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions(shuffled_bytes: int, target_bytes: int = 128 * 1024 * 1024) -> int:
    """How many partitions to start a shuffle with; adaptive execution joins up small ones.

    For ``spark.sql.shuffle.partitions``: Spark's 200 would make 100 GB tasks of
    a 20 TB shuffle.
    """
    return max(200, -(-shuffled_bytes // target_bytes))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    That is the folder named by ``spark.checkpoint.dir``, or the one the context
    was given by ``setCheckpointDir``. A session without either is an error.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def utc(value: datetime | str) -> datetime:
    """An instant as a UTC datetime; text is ISO 8601, no offset means UTC."""
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def instant(value: Column | datetime | str, like: T.DataType | None = None) -> Column:
    """A time literal of the type of the column it is compared with.

    Using the column's own type keeps the comparison free of casts on the
    column, so that range filters still reach the parquet reader.
    """
    if isinstance(value, Column):
        return value
    text = utc(value).replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(like, T.TimestampNTZType):
        return F.lit(text).cast(T.TimestampNTZType())
    return F.lit(text + "Z").cast(T.TimestampType())


def instant_for(df: DataFrame, column: str, value: Column | datetime | str) -> Column:
    return instant(value, df.schema[column].dataType)
