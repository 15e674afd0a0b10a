"""The collected points as a table by cluster and day, in versions.

The collect job appends each micro-batch to a log. Compaction takes the batches
since the last version, merges them with the cluster-days they touch and writes
only these days anew; a list says in which version each day was written last. No
file that a reader may have open is ever replaced: a version is read by its list.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.readings import upsert_readings
from ..operators.rollups import reading_tallies
from ..schemas import ATTRIBUTES, METRICS
from ..sources.store import SORT_WITHIN_FILE
from .sinks import BatchName, finished_batches, write_batch

DAY = ("cluster_id", "event_date")

#: Lists of days and positions of streams up to this many rows are broadcast; they are counted first.
BROADCAST_ROWS = 500_000

#: About how many rows of a cluster-day one task of a compaction takes.
PART_ROWS = 500_000

_TIMES = ("ts", "collected_at", "processed_at")
#: A stored point; given to the reader, since a log in which no message was whole has no files to tell it.
POINT = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("hostname", "gpu_id", "telemetry_id", *ATTRIBUTES, "stream_key")],
    *[T.StructField(c, T.FloatType()) for c in METRICS],
    T.StructField("custom_metrics", T.MapType(T.StringType(), T.FloatType())),
    *[T.StructField(c, T.TimestampType()) for c in _TIMES],
    T.StructField("collector_id", T.StringType()), T.StructField("batch_id", T.StringType()),
    T.StructField("cluster_id", T.StringType()), T.StructField("event_date", T.DateType()),
])

_TALLIES = (
    "cluster_id string, event_date date, n long, sum_gpu_utilization double, sum_memory_utilization double, "
    "n_gpu_utilization long, n_memory_utilization long, last_ts timestamp, written_in int"
)
_LIST = "cluster_id string, event_date date, written_in int, version int"
_POSITIONS = "from_stream string, micro_batch long, version int"


def append_points(points: DataFrame, store: str, batch: BatchName) -> None:
    """A micro-batch of points to the log, by cluster and day."""
    dated = points.withColumn("event_date", F.to_date("ts"))
    write_batch(dated, f"{store}/points", batch, DAY, SORT_WITHIN_FILE)


def _log(spark: SparkSession, store: str) -> DataFrame:
    named = T.StructType([*POINT, T.StructField("from_stream", T.StringType()), T.StructField("micro_batch", T.LongType())])
    return spark.read.schema(named).parquet(f"{store}/points")


def _merged(points: DataFrame, within: Sequence[str] = ("event_date",)) -> DataFrame:
    """The last write per GPU and second; the day is part of the key, so that filters on it reach the files."""
    return upsert_readings(points.drop("telemetry_id"), order=("stream_key",), within=within)


def _merged_for_files(points: DataFrame) -> DataFrame:
    """:func:`_merged`, dealt out once, by day and, in big days, by GPU: as it is merged and as it is written.

    Batches hold a GPU's second once, so there is nothing to merge before. A
    part has at most the rows of one GPU-day more than PART_ROWS or so.
    """
    parts = points.groupBy(*DAY).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("_parts"))
    part = F.pmod(F.xxhash64("hostname", "gpu_id"), F.coalesce("_parts", F.lit(1)))
    dealt = points.join(_small(parts), list(DAY), "left").withColumn("_part", part).drop("_parts")
    return _merged(dealt.repartition(*DAY, "_part"), ("event_date", "_part")).drop("_part")


def _positions(spark: SparkSession, store: str, version: int | None) -> dict[str, int]:
    """The last batch of each stream that a version holds; as many rows as there were streams."""
    if version is None:
        return {}
    rows = spark.read.schema(_POSITIONS).parquet(f"{store}/positions").filter(F.col("version") == version)
    return {r["from_stream"]: r["micro_batch"] for r in rows.collect()}


def _after(done: dict[str, int]) -> Column:
    """Batches after those positions; a condition on folders only."""
    later = [(F.col("from_stream") != s) | (F.col("micro_batch") > n) for s, n in sorted(done.items())]
    return reduce(lambda a, b: a & b, later, F.lit(True))


def _list(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.schema(_LIST).parquet(f"{store}/day-list").filter(F.col("version") == version).drop("version")


def _small(rows: DataFrame) -> DataFrame:
    """A list of days, broadcast if it was found to be small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _days(spark: SparkSession, store: str, listed: DataFrame) -> DataFrame:
    """The points of the listed days, each read in the version that wrote it last.

    All three columns of the join are folders, so that days and versions that are
    not listed are not opened.
    """
    days = spark.read.schema(T.StructType([*POINT, T.StructField("written_in", T.IntegerType())])).parquet(f"{store}/days")
    return days.join(listed, [*DAY, "written_in"]).drop("written_in")


def current_points(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The points with the last write per GPU and second, by ``cluster_id`` and ``event_date``.

    ``version`` names one of :func:`compact_points`; then of the log only later
    batches are read, and only the days that these touch are merged again.
    Filters on cluster and day reach the files either way.
    """
    if version is None:
        return _merged(_log(spark, store).drop("from_stream", "micro_batch"))
    listed = _small(_list(spark, store, version))
    log, touched = _since(spark, store, version)
    untouched = _days(spark, store, listed).join(touched, list(DAY), "left_anti")
    return untouched.unionByName(_merged_since(spark, store, listed, log, touched))


def _since(spark: SparkSession, store: str, version: int) -> tuple[DataFrame, DataFrame]:
    """The points that came after a version, and the days they touch."""
    log = _log(spark, store).filter(_after(_positions(spark, store, version))).drop("from_stream", "micro_batch")
    return log, _small(log.select(*DAY).distinct())


def _merged_since(spark: SparkSession, store: str, listed: DataFrame, log: DataFrame, touched: DataFrame) -> DataFrame:
    before = _days(spark, store, listed).join(touched, list(DAY), "left_semi")
    return _merged(before.unionByName(log))


def current_tallies(spark: SparkSession, store: str, version: int) -> DataFrame:
    """Tallies by cluster and day that add up to those of :func:`current_points`.

    Those of days that nothing came for since the version were kept by its
    compaction; only points of other days are read.
    """
    listed = _small(_list(spark, store, version))
    log, touched = _since(spark, store, version)
    kept = spark.read.schema(_TALLIES).parquet(f"{store}/tallies").join(listed, [*DAY, "written_in"]).drop("written_in")
    fresh = reading_tallies(_merged_since(spark, store, listed, log, touched), DAY)
    return kept.join(touched, list(DAY), "left_anti").unionByName(fresh)


def compact_points(spark: SparkSession, store: str, version: int, previous: int | None = None) -> None:
    """Write a new version: the days touched since the previous one with their tallies, and the list of all days.

    Only finished batches are taken, and each stream's position is kept, so that
    several streams may write to the store.
    """
    done = _positions(spark, store, previous)
    ends = finished_batches(spark, f"{store}/points").filter(_after(done)).groupBy("from_stream").agg(
        F.max("micro_batch").alias("micro_batch")
    )
    upto = {r["from_stream"]: r["micro_batch"] for r in ends.collect()}  # a row per stream that wrote since
    within = reduce(
        lambda a, b: a | b, [(F.col("from_stream") == s) & (F.col("micro_batch") <= n) for s, n in sorted(upto.items())],
        F.lit(False),
    )
    log = _log(spark, store).filter(_after(done) & within).drop("from_stream", "micro_batch")
    touched = _small(log.select(*DAY).distinct())
    rows, kept = log, None
    if previous is not None:
        before = _list(spark, store, previous)
        again = _small(before.join(touched, list(DAY), "left_semi"))
        rows = log.unionByName(_days(spark, store, again))
        kept = before.join(touched, list(DAY), "left_anti")
    merged = _merged_for_files(rows).sortWithinPartitions(*DAY, *SORT_WITHIN_FILE)
    merged.write.mode("errorifexists").partitionBy(*DAY).parquet(f"{store}/days/written_in={version}")
    written = spark.read.schema(POINT).parquet(f"{store}/days/written_in={version}")
    reading_tallies(written, DAY).write.mode("errorifexists").parquet(f"{store}/tallies/written_in={version}")
    listed = touched.withColumn("written_in", F.lit(version))
    listed = listed if kept is None else kept.unionByName(listed)
    listed.write.mode("errorifexists").parquet(f"{store}/day-list/version={version}")
    positions = spark.createDataFrame(sorted({**done, **upto}.items()), "from_stream string, micro_batch long")
    positions.write.mode("errorifexists").parquet(f"{store}/positions/version={version}")
