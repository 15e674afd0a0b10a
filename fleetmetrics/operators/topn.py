"""First n rows per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *,
    lanes: int = 256, rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows per key in ``order``.

    Every task keeps ``n`` rows per key. The tasks' survivors meet in lanes, each
    fed by its share of the tasks, which again keep ``n`` rows per key; the lanes'
    survivors, at most ``n * lanes`` per key, are ranked together. So no task
    ranks what a million others kept of a hot key, and the result is exact.
    """
    inside = Window.partitionBy(*keys, "_lane").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    ranked = (
        df.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_rn") <= n)
        .drop("_lane", "_rn")
        .withColumn("_rn", F.row_number().over(overall))
        .filter(F.col("_rn") <= n)
    )
    return ranked.withColumnRenamed("_rn", rank) if rank else ranked.drop("_rn")
