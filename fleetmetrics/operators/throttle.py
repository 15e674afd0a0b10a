"""Token-bucket flags: which rows exceed a rate."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batching import RANGE_ROWS, by_ranges, join_null_safe

# The row code below travels with its tasks; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rate per second and bucket size.
DEFAULT_RATE, DEFAULT_BURST = 1000.0, 100

#: When rows without a time came: long before all others, at one moment.
LONG_AGO = -(10**17)

#: A bucket counts as full only if it would overflow by this share of a token, so that rounding cannot matter.
MARGIN = 0.01


class Bucket:
    """Starts full, refills with time up to its size; a refused row costs nothing."""

    def __init__(self, rate: float, burst: float, tokens: float | None = None, last: int | None = None):
        self.rate, self.burst = rate, float(burst)
        self.tokens = self.burst if tokens is None else tokens
        self.last = last

    def take(self, micros: int | None) -> bool:
        moment = LONG_AGO if micros is None else micros
        elapsed = 0 if self.last is None else max(0, moment - self.last)
        self.last = moment if self.last is None else max(moment, self.last)
        self.tokens = min(self.burst, self.tokens + elapsed / 1e6 * self.rate)
        if self.tokens >= 1.0:
            self.tokens -= 1.0
            return True
        return False


def _segments(rows: DataFrame, key: str, rate: float) -> DataFrame:
    """Rows with ``_segment``: numbered per key, a new one wherever the bucket is surely full.

    A bucket that charges every row, also those refused, never holds more than
    the true one. Its backlog before the nth row is the greatest that n minus the
    tokens refilled by then has risen above an earlier value of the same; so
    where that number falls below all earlier ones both buckets are full, and
    what follows does not depend on what was before. The number's minimum and
    the rows before are carried from run to run.
    """
    runs = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "_range").orderBy("_micros", "_seq")
    refilled = F.col("_micros").cast("double") * F.lit(rate / 1e6)
    local = rows.withColumn("_rise", F.row_number().over(inside) - refilled)
    carried = (
        local.groupBy(key, "_range")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_rise").alias("_low"))
        .withColumn("_rows", F.coalesce(F.sum("_n").over(runs), F.lit(0)))
        .withColumn("_before", F.min(F.col("_low") + F.col("_rows")).over(runs))
        .select(key, "_range", "_rows", "_before")
    )
    lowest = F.min("_rise").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    cuts = (
        join_null_safe(local, carried, [key, "_range"])
        .withColumn("_rise", F.col("_rise") + F.col("_rows"))
        .withColumn("_lowest", F.least(lowest, "_before"))
        .withColumn("_cut", F.coalesce((F.col("_rise") < F.col("_lowest") - MARGIN).cast("int"), F.lit(0)))
    )
    starts = (
        cuts.groupBy(key, "_range")
        .agg(F.sum("_cut").alias("_cuts"))
        .withColumn("_start", F.coalesce(F.sum("_cuts").over(runs), F.lit(0)))
        .drop("_cuts")
    )
    return join_null_safe(cuts, starts, [key, "_range"]).withColumn(
        "_segment",
        F.col("_start") + F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    )


def throttle_flags(
    df: DataFrame, key: str, rate: float = DEFAULT_RATE, burst: int = DEFAULT_BURST,
    ts: str = "ts", seq: str = "seq", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Rows with ``allowed``: whether the key's bucket still had a token at that time.

    Each key's rows are cut wherever its bucket is surely full, so that a key
    whose rate stays below the limit on the whole is walked by many tasks even if
    it never rests; each task walks its sorted rows batch by batch and holds one
    bucket at a time. Only a key that stays over its limit is one long segment.
    A NULL key is a key like others. Rows without a time come first, long before
    the others; equal times go by ``seq``.
    """
    moment = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(LONG_AGO))
    timed = df.withColumn("_micros", moment).withColumn("_seq", F.col(seq))
    split = _segments(by_ranges(timed, [key], ["_micros", "_seq"], range_rows), key, rate)
    ordered = (
        split.select(*df.columns, "_micros", "_segment")
        .repartition(key, "_segment")
        .sortWithinPartitions(key, "_segment", "_micros", seq)
    )
    schema = T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType())])
    columns = df.columns

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bucket = None, Bucket(rate, burst)
        for batch in batches:
            # The columns pass through as they are; only the flags are new.
            named = dict(zip(batch.schema.names, batch.columns))
            flags = []
            for owner, part, micros in zip(*(named[c].to_pylist() for c in (key, "_segment", "_micros"))):
                owner = "NaN" if owner != owner else owner  # NaN is one key
                if current != (owner, part):
                    current, bucket = (owner, part), Bucket(rate, burst)
                flags.append(bucket.take(micros))
            yield pa.RecordBatch.from_arrays(
                [*[named[c] for c in columns], pa.array(flags, pa.bool_())], [*columns, "allowed"]
            )

    return ordered.mapInArrow(walk, schema)
