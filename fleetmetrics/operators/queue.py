"""A message log as a table: reading, claiming, acknowledging, expiry, recovery, counts.

Messages have ``message_id``, ``topic``, ``stream_key``, ``created_at`` and
``expires_at``; keys of a topic sort by age. Acknowledgements have
``message_id``, ``topic`` and ``consumer_id``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import instant, instant_for, utc
from ..sources.messages import QUEUE_PREFIX
from .topn import first_n_per_key

def live_messages(df: DataFrame, as_of: datetime | str) -> DataFrame:
    """Messages not yet expired; a message expires strictly after ``expires_at``."""
    return df.filter(F.col("expires_at") >= instant_for(df, "expires_at", as_of))


def expired_messages(df: DataFrame, as_of: datetime | str) -> DataFrame:
    return df.filter(F.col("expires_at") < instant_for(df, "expires_at", as_of))


def expired_unacked(messages: DataFrame, acks: DataFrame, as_of: datetime | str) -> DataFrame:
    """Expired messages that had no acknowledgement (``acked_at``) by their deadline."""
    first = acks.groupBy("message_id").agg(F.min("acked_at").alias("_acked_at"))
    late = F.col("_acked_at").isNull() | (F.col("_acked_at") > F.col("expires_at"))
    return (
        expired_messages(messages, as_of)
        .join(first, "message_id", "left")
        .filter(late)
        .drop("_acked_at")
    )


def consume_fifo(df: DataFrame, topic: str, n: int, as_of: datetime | str) -> DataFrame:
    """The oldest ``n`` messages of a topic, of which the expired ones are then dropped."""
    oldest = df.filter(F.col("topic") == topic).orderBy("stream_key").limit(n)
    return live_messages(oldest, as_of)


def consume_many(
    df: DataFrame, topics: Sequence[str], n: int, as_of: datetime | str
) -> DataFrame:
    """:func:`consume_fifo` for each of several topics at once."""
    wanted = df.filter(F.col("topic").isin(list(topics)))
    oldest = first_n_per_key(wanted, ["topic"], [F.col("stream_key")], n)
    return live_messages(oldest, as_of)


def claim_work(
    df: DataFrame, topic: str, consumers: Sequence[str], n: int, as_of: datetime | str
) -> tuple[DataFrame, DataFrame]:
    """(claimed, remaining): each consumer gets ``n`` of the oldest messages, none twice.

    The oldest messages are dealt out in turn. All of them leave the queue; the
    claimed ones that are expired are not handed to the consumer.
    """
    wanted = n * len(consumers)
    taken = first_n_per_key(
        df.filter(F.col("topic") == topic), ["topic"], [F.col("stream_key")], wanted,
        rank="claim_no",
    )
    nanos = F.lit(str(round(utc(as_of).timestamp() * 1_000_000) * 1000))
    turn = F.pmod(F.col("claim_no") - 1, F.lit(len(consumers))).cast("int")
    consumer = F.element_at(F.array(*map(F.lit, consumers)), turn + 1)
    rest_of_key = F.substring_index("stream_key", "/", -1)
    claimed = live_messages(taken, as_of).withColumn("consumer_id", consumer).withColumn(
        "processing_key",
        F.concat(F.lit("/processing/"), "consumer_id", F.lit("/"), nanos, F.lit("_"), rest_of_key),
    )
    return claimed, df.join(taken.select("stream_key"), "stream_key", "left_anti")


def ack_messages(messages: DataFrame, acks: DataFrame) -> DataFrame:
    """Messages left in the queue after acknowledgement."""
    return messages.join(acks.select("message_id").distinct(), "message_id", "left_anti")


def ack_outcome(messages: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acked, failed) ids: an id is acked if its message exists."""
    ids = acks.select("message_id").distinct()
    known = messages.select("message_id").distinct()
    return ids.join(known, "message_id", "left_semi"), ids.join(known, "message_id", "left_anti")


def list_topics(messages: DataFrame) -> DataFrame:
    """Topics that have at least one message."""
    return messages.select("topic").distinct()


def topic_exists(messages: DataFrame, topic: str) -> bool:
    return not messages.filter(F.col("topic") == topic).isEmpty()


def queue_depth(messages: DataFrame, topic: str | None = None) -> DataFrame:
    """Messages per topic."""
    if topic:
        messages = messages.filter(F.col("topic") == topic)
    return messages.groupBy("topic").agg(F.count(F.lit(1)).alias("depth"))


def topic_stats(messages: DataFrame, acks: DataFrame, as_of: datetime | str) -> DataFrame:
    """Per topic: messages, consumers, last message, processed and pending messages."""
    acked = acks.select("message_id").distinct().withColumn("_acked", F.lit(True))
    done = F.col("_acked").isNotNull()
    alive = F.col("expires_at") >= instant_for(messages, "expires_at", as_of)
    counts = (
        messages.select("message_id", "topic", "created_at", "expires_at")
        .join(acked, "message_id", "left")
        .groupBy("topic")
        .agg(
            F.count(F.lit(1)).alias("message_count"),
            F.max("created_at").alias("last_message"),
            F.count_if(done).alias("processed_count"),
            F.count_if(~done & alive).alias("pending_count"),
        )
    )
    consumers = acks.groupBy("topic").agg(F.count_distinct("consumer_id").alias("_consumers"))
    return counts.join(consumers, "topic", "left").select(
        "topic", "message_count", F.coalesce("_consumers", F.lit(0)).alias("consumer_count"),
        "last_message", "processed_count", "pending_count",
    )


def queue_totals(messages: DataFrame, acks: DataFrame, as_of: datetime | str) -> DataFrame:
    """All topics together: total, pending, processed, and acknowledgements that failed."""
    ids = acks.select("message_id").distinct().withColumn("_acked", F.lit(True))
    log = messages.select("message_id", "expires_at").withColumn("_known", F.lit(True))
    known, acked = F.col("_known").isNotNull(), F.col("_acked").isNotNull()
    alive = F.col("expires_at") >= instant_for(messages, "expires_at", as_of)
    return log.join(ids, "message_id", "full").agg(
        F.count_if(known).alias("total_messages"),
        F.count_if(known & ~acked & alive).alias("pending_messages"),
        F.count_if(known & acked).alias("processed_messages"),
        F.count_if(~known).alias("failed_messages"),
    )


def recover_orphans(
    queue: DataFrame, processing: DataFrame, as_of: datetime | str, max_age_seconds: float,
    prefix: str = QUEUE_PREFIX,
) -> tuple[DataFrame, DataFrame]:
    """(queue, processing) after messages in process for longer than ``max_age_seconds``,
    counted from their creation, went back to the queue under a new key."""
    cutoff = datetime.fromtimestamp(utc(as_of).timestamp() - max_age_seconds, utc(as_of).tzinfo)
    stale = F.col("created_at") < instant_for(processing, "created_at", cutoff)
    now = instant(as_of)
    key = F.concat(
        F.lit(f"{prefix}/"), "topic", F.lit("/"),
        (F.unix_micros(now) * 1000).cast("string"), F.lit("_"), "message_id", F.lit("_"),
        F.unix_seconds(now).cast("string"),
    )
    back = processing.filter(stale).withColumn("stream_key", key).select(*queue.columns)
    return queue.unionByName(back), processing.filter(~stale)
