"""Idempotent batch output, retries, and running totals."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

# Tries per batch and the base delay between them, in seconds.
MAX_RETRIES, RETRY_DELAY = 3, 1.0


@dataclass(frozen=True)
class BatchName:
    """A micro-batch: the id of its stream, which the stream's checkpoint keeps over restarts, and its number."""

    stream: str
    number: int

    @property
    def folder(self) -> str:
        return f"from_stream={self.stream}/micro_batch={self.number}"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id in a running stream's checkpoint."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def write_batch(
    df: DataFrame, path: str, batch: BatchName, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()
) -> None:
    """Write a micro-batch to its own folder; a replay of one that was finished does nothing.

    The folder is named by stream and number, so streams that share ``path`` stay
    apart. When all files are there, a mark is written beside the data; a folder
    without one is what an interrupted write has left, and is replaced. With
    ``partition_by`` the batch has folders by these columns.
    """
    spark = df.sparkSession
    folder, mark = f"{path}/{batch.folder}", f"{path}/{_MARKS}/{batch.folder}"
    if _exists(spark, mark):
        return
    if partition_by:
        df = df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by, *sort_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    spark.range(0, 1, 1, 1).write.mode("overwrite").parquet(mark)


#: Where the marks of finished batches lie; readers of the data pass over names that begin so.
_MARKS = "_finished"


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("id long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def finished_batches(spark: SparkSession, path: str) -> DataFrame:
    """``from_stream, micro_batch`` of the finished batches below ``path``; none where nothing was written."""
    marks, schema = f"{path}/{_MARKS}", "id long, from_stream string, micro_batch long"
    if not _exists(spark, marks):
        return spark.createDataFrame([], schema).drop("id")
    return spark.read.schema(schema).parquet(marks).drop("id")


def read_batches_of(spark: SparkSession, path: str) -> DataFrame:
    """All micro-batches below ``path``, without the names of their folders."""
    return read_named_batches(spark, path).drop("from_stream", "micro_batch")


def read_named_batches(spark: SparkSession, path: str) -> DataFrame:
    """All micro-batches below ``path``, with ``from_stream`` and ``micro_batch``.

    Folder names are read as text, but for the number of the batch and dates: a
    cluster may be called 007.
    """
    found = spark.read.parquet(path)
    kinds = {"micro_batch": T.LongType(), "written_in": T.IntegerType(), "event_date": T.DateType()}
    folders = {"from_stream", "cluster_id", *kinds}
    if all(found.schema[c].dataType == kinds.get(c, T.StringType()) for c in folders & set(found.columns)):
        return found
    fields = [
        T.StructField(f.name, kinds.get(f.name, T.StringType())) if f.name in folders else f for f in found.schema.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The rows, worked out once for several outputs; what a lost executor held is worked out again."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


@dataclass
class SenderTotals:
    """Counts kept by the driver of a stream."""

    records: int = 0
    batches: int = 0
    errors: int = 0
    last_process_time: datetime | None = None
    attempts: list[int] = field(default_factory=list)
    started_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    @property
    def processing_rate(self) -> float:
        """Records per second from the start to the last batch."""
        last = self.last_process_time
        elapsed = (last - self.started_at).total_seconds() if last else 0
        return self.records / elapsed if elapsed > 0 else 0.0


class SenderListener(StreamingQueryListener):
    """Adds up what the batches of observed streams report. See :func:`observed`."""

    def __init__(self, name: str = "sender"):
        self.name, self.totals = name, SenderTotals()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row["records"]:
            self.totals.records += row["records"]
            self.totals.batches += 1
            self.totals.last_process_time = datetime.now(timezone.utc)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.totals.errors += event.exception is not None


def observed(sdf: DataFrame, name: str = "sender") -> DataFrame:
    """The same stream, counted on the way without a pass of its own."""
    return sdf.observe(name, F.count(F.lit(1)).alias("records"))


def write_with_retry(
    batch: DataFrame, writer: Callable[[DataFrame], None], retries: int = MAX_RETRIES,
    delay: float = RETRY_DELAY, totals: SenderTotals | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> int:
    """Call ``writer(batch)`` up to ``retries`` times and give the number of tries.

    The n-th wait lasts n times ``delay``. If every try fails, the error goes up:
    the stream does not commit the batch, and it is sent again on restart. The
    writer must be idempotent.
    """
    totals = totals if totals is not None else SenderTotals()
    for attempt in range(1, retries + 1):
        try:
            writer(batch)
        except Exception:
            if attempt == retries:
                totals.errors += 1
                totals.last_process_time = datetime.now(timezone.utc)
                raise
            sleep(attempt * delay)
        else:
            totals.batches += 1
            totals.attempts.append(attempt)
            totals.last_process_time = datetime.now(timezone.utc)
            return attempt
    raise ValueError("retries must be at least 1")


def start_batches(
    sdf: DataFrame, handle: Callable[[DataFrame, BatchName], None], checkpoint: str,
    interval: str | None = None, mode: str = "append",
) -> StreamingQuery:
    """Run ``handle`` on every micro-batch; without an interval, until the input is used up."""
    own: list[str] = []

    def named(batch: DataFrame, number: int) -> None:
        if not own:
            own.append(stream_id(batch.sparkSession, checkpoint))
        handle(batch, BatchName(own[0], number))

    writer = sdf.writeStream.outputMode(mode).foreachBatch(named).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def start_table(
    sdf: DataFrame, path: str, checkpoint: str, mode: str = "append",
    interval: str | None = None,
) -> StreamingQuery:
    """Write each micro-batch of ``sdf`` to its own folder below ``path``."""
    return start_batches(sdf, lambda batch, name: write_batch(batch, path, name), checkpoint, interval, mode)
