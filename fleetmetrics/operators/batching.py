"""Row positions within a key, and batches of a fixed size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import partition_key
from ..session import shared_dir

#: How many rows one window task is meant to see of one key. The task that writes a run sorts it: 300 bytes a row for
#: readings, so some 150 MB.
RANGE_ROWS = 500_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a NULL key meets a NULL key; the keys are those of the left side."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"_of_{k}" for k in keys])


def by_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Rows with ``_range``: the number of a run of about ``range_rows`` rows in the order of keys and ``order``.

    Spark samples where the runs end, so they are even however the values are
    spread, and a key with most of the rows has many. Rows that agree in all of
    these columns are in one run; NULLs come first. The runs are written to the
    shared folder, because a second pass over a sample would cut elsewhere.
    """
    runs = -(-df.count() // range_rows)
    if runs <= 1:
        return df.withColumn("_range", F.lit(0))
    spark = df.sparkSession
    path = shared_dir(spark, "ranges")
    placed = df.repartitionByRange(runs, *keys, *order).withColumn("_range", F.spark_partition_id())
    placed.write.partitionBy("_range").parquet(path)  # a folder per run: a reader of some runs opens no others
    return spark.read.schema(placed.schema).parquet(path)


def running_position(
    df: DataFrame, keys: Sequence[str], seq: str, *, into: str, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """The position of each row within its key in ``seq`` order, counted from 0.

    ``seq`` is a unique whole number; rows without one come first, in no order.
    Rows with a NULL key are a key of their own. The rows are cut into even runs;
    row counts per key and run, summed up over the earlier runs, say where a run
    starts, and only inside a run are rows sorted. So a key that holds most of
    the table is spread over as many tasks as it has runs.
    """
    rows = by_ranges(df, keys, [seq], range_rows)
    earlier = (
        Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(seq)
    return (
        join_null_safe(rows, starts, [*keys, "_range"])
        .withColumn(into, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_range", "_start")
    )


def number_batches(
    df: DataFrame, by: str, size: int, seq: str = "seq", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Each row with its ``partition`` and ``batch_no``: batches of ``size`` in ``seq`` order."""
    placed = running_position(
        df.withColumn("partition", partition_key(by)), ["partition"], seq,
        into="_position", range_rows=range_rows,
    )
    return placed.withColumn("batch_no", F.floor(F.col("_position") / size)).drop("_position")


def pack_batches(
    df: DataFrame, by: str, size: int, seq: str = "seq", ts: str = "ts",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Batches of at most ``size`` rows per partition key, in arrival order.

    Only the last batch of a partition is short.
    """
    numbered = number_batches(df, by, size, seq, range_rows)
    record = F.struct(seq, *[c for c in df.columns if c != seq])
    place = lambda r: F.coalesce(r[seq], F.lit(-(2**63)).cast("long"))
    return numbered.groupBy("partition", "batch_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.array_sort(
            F.collect_list(record),
            lambda a, b: F.when(place(a) > place(b), 1).when(place(a) < place(b), -1).otherwise(0),
        ).alias("records"),
    )
