"""Change logs and snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batching import RANGE_ROWS, by_ranges, join_null_safe


def classify_changes(
    changelog: DataFrame, keys: Sequence[str], seq: str = "seq", op: str = "op",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Each PUT as ``create`` or ``update`` and each DELETE as ``delete``, in ``event_type``.

    A put is a creation if the key was never put before or was deleted last.
    ``seq`` is a unique whole number. Each run of rows (:func:`by_ranges`) takes
    the key's last operation from the runs before, so a hot key needs no single
    window. A NULL key is a key like others; rows without ``seq`` come first.
    """
    rows = by_ranges(changelog, keys, [seq], range_rows).withColumn("_gone", F.col(op) == "DELETE")
    by_range = Window.partitionBy(*keys).orderBy("_range")
    # A key's last row of a run: rows without seq come before all others.
    place = F.struct(F.col(seq).isNotNull(), F.col(seq))
    carried = (
        rows.groupBy(*keys, "_range")
        .agg(F.max_by("_gone", place).alias("_last"))
        .withColumn("_before", F.lag("_last").over(by_range))
        .drop("_last")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(seq)
    absent = F.coalesce(F.lag("_gone").over(inside), F.col("_before"), F.lit(True))
    return (
        join_null_safe(rows, carried, [*keys, "_range"])
        .withColumn("_absent", absent)
        .withColumn(
            "event_type",
            F.when(F.col("_gone"), "delete").when(F.col("_absent"), "create").otherwise("update"),
        )
        .drop("_range", "_gone", "_before", "_absent")
    )


def current_config(
    changelog: DataFrame, defaults: Mapping[str, str] | DataFrame | None = None,
    seq: str = "seq",
) -> DataFrame:
    """The present value per key: latest PUT, nothing after a DELETE, else the default.

    Columns ``key``, ``type`` (PUT or DELETE), ``value`` (JSON text) and ``seq``;
    a PUT whose value is not JSON is ignored.
    """
    usable = (F.col("type") == "DELETE") | F.try_parse_json("value").isNotNull()
    latest = (
        changelog.filter(usable)
        .groupBy("key")
        .agg(F.max_by(F.struct("type", "value"), seq).alias("_c"))
    )
    present = latest.filter(F.col("_c.type") == "PUT").select("key", F.col("_c.value"))
    if defaults is None:
        return present
    if not isinstance(defaults, DataFrame):
        defaults = SparkSession.active().createDataFrame(
            list(defaults.items()), "key string, value string"
        )
    unset = defaults.select("key", "value").join(present.select("key"), "key", "left_anti")
    return present.unionByName(unset)


def _comparable(df: DataFrame, columns: Sequence[str]):
    """A struct of the columns with maps, which have no equality, as sorted entries."""
    return F.struct(
        *[
            F.array_sort(F.map_entries(c)).alias(c)
            if isinstance(df.schema[c].dataType, T.MapType)
            else F.col(c)
            for c in columns
        ]
    )


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys created, updated or deleted between two snapshots with unique keys."""
    rest = [c for c in new.columns if c not in keys]
    left = old.select(*keys, _comparable(old, rest).alias("_old"), F.lit(True).alias("_in_old"))
    right = new.select(*keys, _comparable(new, rest).alias("_new"), F.lit(True).alias("_in_new"))
    event = (
        F.when(F.col("_in_old").isNull(), "create")
        .when(F.col("_in_new").isNull(), "delete")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    )
    return (
        left.join(right, list(keys), "full")
        .select(*keys, event.alias("event_type"))
        .filter(F.col("event_type").isNotNull())
    )
