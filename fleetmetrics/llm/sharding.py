"""Rendezvous hashing of stable keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import text_of


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """A key's score for a shard: weight over -ln(u), u from 52 bits of a hash of key and shard.

    The greatest of several such scores falls to a shard in proportion to its
    weight, and a score depends on no other shard.
    """
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("long")), 12)
    unit = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-52)
    return F.lit(float(weight)) / -F.log(unit)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, with the greatest score; ties go to the lower number.

    A shard whose weight is 0 gets nothing. Raising one weight, or adding a
    shard at the end, moves rows only into that shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scores = F.array(*[shard_score(key, s, w) for s, w in enumerate(weights)])
    return F.array_position(scores, F.array_max(scores)).cast("int") - F.lit(1)


def shard_documents(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weight: float | None = None,
    key: str = "doc_id",
    text: str = "text",
    slot_parts: int = 64,
) -> DataFrame:
    """Each document's shard and its place there.

    Returns ``key, size, text_crc32, shard, slot`` and, with ``grown_weight``,
    ``grown_shard``: the shard once one more of that weight is added. ``size``
    is the text's bytes in UTF-8 plus 1; a null text has size 1 and the checksum
    of no bytes. Slots are gapless from 0 within a shard. A shard's rows are
    numbered in ``slot_parts`` parts by a hash of the row, so that no task holds
    a whole shard; raise it with the table.

    A null key is a key like others. Rows that repeat a key share its shard and
    have a slot each. An empty table gives an empty table; other columns are
    ignored, whatever their names.
    """
    name = F.col(key)
    body = text_of(text)
    grown = [] if grown_weight is None else [
        rendezvous_shard(name, [*weights, grown_weight]).alias("grown_shard")
    ]
    placed = docs.select(
        name.alias(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        rendezvous_shard(name, weights).alias("shard"),
        *grown,
    ).withColumn("part", F.pmod(F.xxhash64(key, "size", "text_crc32"), F.lit(slot_parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy(F.col(key), "text_crc32", "size")
    numbered = placed.withColumn("row", F.row_number().over(within) - F.lit(1))
    return numbered.join(offsets, ["shard", "part"]).select(
        key, "size", "text_crc32", "shard",
        (F.col("offset") + F.col("row")).alias("slot"),
        *[F.col("grown_shard") for _ in grown],
    )
