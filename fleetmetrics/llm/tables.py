"""Intermediate tables in the folder all executors share, and checks of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read back: work that is used twice is done once.

    The files lie below ``spark.checkpoint.dir``, so a lost executor costs no
    more than its running tasks.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text: two 64-bit hashes with different seeds."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


#: In how many parts the rows of one key are dealt by :func:`spread_join`.
WAYS = 64


def spread_join(rows: DataFrame, known: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Rows with what is ``known`` of their keys, one row per key, also where a key holds a third of the rows.

    The rows of a key are dealt in WAYS parts by the hash of ``by``; what is known
    of the key goes to each part that there is. Keys are not null.
    """
    way = max([*rows.columns, *known.columns], key=len) + "_"  # no other column's name
    dealt = rows.withColumn(way, F.pmod(F.xxhash64(by), F.lit(WAYS)))
    places = dealt.select(*keys, way).distinct().join(known, keys, how)
    return dealt.join(places, [*keys, way]).drop(way)
