"""Operators with their own keyed state: expiry, throttling, change events.

They need the RocksDB state store (``session.RECOMMENDED_CONF``).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.registry import STATUS_METRICS
from ..operators.throttle import DEFAULT_BURST, DEFAULT_RATE, Bucket
from ..schemas import IDENTITY
from .sinks import BatchName, start_batches

# The row code below travels with its tasks; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _nulls_first(values: tuple) -> list[tuple]:
    """A key that sorts NULL before any value, as the batch forms do."""
    return [(v is not None, v if v is not None else 0) for v in values]


#: Into how many buckets :func:`expire_stream` deals messages. A checkpoint keeps the number it began with.
EXPIRY_BUCKETS = 16_384


class _Expiry(StatefulProcessor):
    """The messages of a bucket that wait for their deadlines, as one value of state with one timer, at the earliest.

    A call to the state store costs as much as handling a thousand messages, so
    a bucket's are read and written together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        texts, numbers = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
        self._state = handle.getValueState(
            "waiting",
            T.StructType()
            .add("ids", texts).add("topics", texts).add("expires", numbers).add("acked", numbers)
            .add("timer", T.LongType()),
        )

    @staticmethod
    def _timer(expires: int | None, acked: int | None) -> int | None:
        # A message is dead strictly after its deadline; timers count milliseconds.
        # An acknowledgement without a message is forgotten at its own time.
        micros = acked if expires is None else expires
        return None if micros is None else micros // 1000 + 1

    def _waiting(self) -> tuple[dict[str | None, tuple], int | None]:
        """(topic, expires, acked) by message id, and the timer that is registered."""
        known = self._state.get()
        if known is None:
            return {}, None
        ids, *columns, timer = known
        return dict(zip(ids, zip(*columns))), timer

    def _keep(self, waiting: dict[str | None, tuple], before: int | None) -> None:
        timers = (self._timer(expires, acked) for _, expires, acked in waiting.values())
        after = min((t for t in timers if t is not None), default=None)
        if before != after:
            if before is not None:
                self._handle.deleteTimer(before)
            if after is not None:
                self._handle.registerTimer(after)
        if waiting:
            self._state.update(([*waiting], *map(list, zip(*waiting.values())), after))
        else:
            self._state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        waiting, timer = self._waiting()
        touched = set()
        for row in rows:
            message, acked = row["message_id"], row["acked"]
            known = waiting.get(message, (None, None, None))
            if acked is not None:
                waiting[message] = (*known[:2], acked if known[2] is None else min(acked, known[2]))
            else:
                waiting[message] = (row["topic"], row["expires"], known[2])
            touched.add(message)
        for message in touched:
            _, expires, acked = waiting[message]
            if expires is not None and acked is not None and acked <= expires:
                del waiting[message]
        self._keep(waiting, timer)
        yield from ()

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[Row]:
        waiting, _ = self._waiting()
        now, left = timerValues.getCurrentWatermarkInMs(), {}
        for message, (topic, expires, acked) in waiting.items():
            timer = self._timer(expires, acked)
            if timer is None or timer > now:
                left[message] = (topic, expires, acked)
            elif expires is not None:
                yield Row(message_id=message, topic=topic, expires_micros=expires)
        self._keep(left, None)  # the timer that fired is gone

    def close(self) -> None:
        pass


def expire_stream(
    messages: DataFrame, acks: DataFrame, delay: str = "10 minutes", buckets: int = EXPIRY_BUCKETS
) -> DataFrame:
    """Messages that reached ``expires_at`` without an acknowledgement by then.

    Event time is ``created_at`` of messages and ``acked_at`` of
    acknowledgements; ``delay`` says how late either may come. State is kept in
    ``buckets`` by a hash of the id: a thousand messages that wait to a bucket
    are about right.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = F.lit(None)
    # One watermark per input: the slower of the two sets the pace.
    sent = messages.select(
        "message_id", "topic", F.col("created_at").cast("timestamp").alias("_time"),
        micros("expires_at").alias("expires"), none.cast("long").alias("acked"),
    ).withWatermark("_time", delay)
    acked = acks.select(
        "message_id", none.cast("string").alias("topic"),
        F.col("acked_at").cast("timestamp").alias("_time"),
        none.cast("long").alias("expires"), micros("acked_at").alias("acked"),
    ).withWatermark("_time", delay)
    timed = sent.unionByName(acked).withColumn("bucket", F.pmod(F.xxhash64("message_id"), F.lit(buckets)))
    schema = "message_id string, topic string, expires_micros long"
    return (
        timed.groupBy("bucket")
        .transformWithState(_Expiry(), schema, "Append", "EventTime")
        .select(
            "message_id", "topic", F.timestamp_micros("expires_micros").alias("expired_at")
        )
    )


class _Slices:
    """A key's rows that wait for their turn: by slices of event time, each given out when the watermark has passed it.

    A slice is an entry of map state with a timer of its own, so that only the
    rows of one slice of a key are ever held in a list.
    """

    def __init__(self, handle: StatefulProcessorHandle, millis: int) -> None:
        self._handle, self._millis = handle, millis
        self._state = handle.getMapState(
            "waiting", T.StructType().add("slice", T.LongType()),
            T.StructType().add("rows", T.ArrayType(T.StringType())),
        )

    def add(self, rows: Iterator[tuple]) -> None:
        """Rows whose first value is their time in microseconds."""
        by_slice: dict[int, list[str]] = {}
        for row in rows:
            by_slice.setdefault(row[0] // 1000 // self._millis, []).append(json.dumps(row))
        for place, found in sorted(by_slice.items()):
            if self._state.containsKey((place,)):
                found = [*self._state.getValue((place,))[0], *found]
            else:
                self._handle.registerTimer((place + 1) * self._millis)
            self._state.updateValue((place,), (found,))

    def due(self, expiry: int) -> list[tuple]:
        """The rows of the slice that ends then; it is forgotten."""
        place = expiry // self._millis - 1
        if not self._state.containsKey((place,)):
            return []
        rows = [tuple(json.loads(one)) for one in self._state.getValue((place,))[0]]
        self._state.removeKey((place,))
        return rows


class _Throttle(StatefulProcessor):
    def __init__(self, rate: float, burst: float, slice_millis: int = 0):
        self._rate, self._burst, self._millis = rate, burst, slice_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._waiting = _Slices(handle, self._millis) if self._millis else None
        self._state = handle.getValueState(
            "bucket",
            T.StructType().add("tokens", T.DoubleType()).add("last", T.LongType()),
        )

    def _take(self, key: Any, rows: list[tuple]) -> Iterator[Row]:
        tokens, last = self._state.get() if self._state.exists() else (None, None)
        bucket = Bucket(self._rate, self._burst, tokens, last)
        for micros, seq in sorted(rows, key=_nulls_first):
            yield Row(key=key[0], seq=seq, micros=micros, allowed=bucket.take(micros))
        self._state.update((bucket.tokens, bucket.last))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found = ((r["_micros"], r["_seq"]) for r in rows)
        if self._waiting is None:
            # The rows of one key within one micro-batch, which the source's rate limit bounds.
            yield from self._take(key, list(found))
        else:
            self._waiting.add(found)

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[Row]:
        yield from self._take(key, self._waiting.due(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def throttle_stream(
    sdf: DataFrame, key: str, rate: float = DEFAULT_RATE, burst: int = DEFAULT_BURST,
    ts: str = "ts", seq: str = "seq", delay: str | None = None, slice_seconds: float = 1.0,
) -> DataFrame:
    """Key, ``seq``, time and ``allowed`` per row; the bucket of a key lives on between batches.

    Rows are judged as they come: one older than the key's newest refills
    nothing. With ``delay`` they wait until the watermark has passed their slice of
    ``slice_seconds``, and are judged in the order of time and ``seq`` whatever
    batch they came in, as :func:`throttle_flags` does; rows still later are
    dropped, as are those without a time, and the last ones wait for newer rows.
    """
    rows = sdf.select(
        F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_time"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_micros"),
        F.col(seq).cast("long").alias("_seq"),
    )
    rows, mode, millis = _timed(rows, delay, slice_seconds)
    kind = sdf.schema[key].dataType.simpleString()
    out = rows.groupBy("_key").transformWithState(
        _Throttle(rate, burst, millis), f"key {kind}, seq long, micros long, allowed boolean",
        "Append", mode,
    )
    return out.select(
        F.col("key").alias(key), F.col("seq").alias(seq),
        F.timestamp_micros("micros").alias(ts), "allowed",
    )


def _timed(rows: DataFrame, delay: str | None, slice_seconds: float) -> tuple[DataFrame, str, int]:
    """The rows with a watermark if there is a delay, the time mode, and the slices' length."""
    if delay is None:
        return rows.drop("_time"), "None", 0
    timed = rows.filter(F.col("_time").isNotNull()).withWatermark("_time", delay)
    return timed, "EventTime", max(1, round(slice_seconds * 1000))


class _Changes(StatefulProcessor):
    def __init__(self, slice_millis: int = 0):
        self._millis = slice_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._waiting = _Slices(handle, self._millis) if self._millis else None
        self._state = handle.getValueState(
            "present", T.StructType().add("present", T.BooleanType())
        )

    def _tell(self, key: Any, rows: list[tuple]) -> Iterator[Row]:
        present = self._state.exists() and self._state.get()[0]
        for *_, seq, op, value in sorted(rows, key=_nulls_first):
            if op == "DELETE":
                event, present = "delete", False
            else:
                event, present = ("update" if present else "create"), True
            yield Row(key=key[0], seq=seq, event_type=event, value=value)
        self._state.update((present,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if self._waiting is None:
            # The rows of one key within one micro-batch, which the source's rate limit bounds.
            yield from self._tell(key, [(r["_seq"], r["_op"], r["_value"]) for r in rows])
        else:
            self._waiting.add((r["_micros"], r["_seq"], r["_op"], r["_value"]) for r in rows)

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[Row]:
        yield from self._tell(key, self._waiting.due(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def change_events(
    sdf: DataFrame, key: str = "key", seq: str = "seq", op: str = "op", value: str = "value",
    ts: str = "ts", delay: str | None = None, slice_seconds: float = 1.0,
) -> DataFrame:
    """Each change of a key as create, update or delete, across micro-batches.

    Within a micro-batch changes go by ``seq``. With ``delay`` they wait, as in
    :func:`throttle_stream`, and go by time ``ts`` and then ``seq`` whatever batch
    they came in.
    """
    rows = sdf.select(
        F.col(key).cast("string").alias("_key"), F.col(seq).cast("long").alias("_seq"),
        F.col(op).alias("_op"),
        F.coalesce(F.col(value).cast("string"), F.lit("")).alias("_value"),
        *(
            [] if delay is None else [
                F.col(ts).cast("timestamp").alias("_time"),
                F.unix_micros(F.col(ts).cast("timestamp")).alias("_micros"),
            ]
        ),
    )
    mode, millis = "None", 0
    if delay is not None:
        rows, mode, millis = _timed(rows, delay, slice_seconds)
    out = rows.groupBy("_key").transformWithState(
        _Changes(millis), "key string, seq long, event_type string, value string", "Append", mode
    )
    return out.select(
        F.col("key").alias(key), F.col("seq").alias(seq), "event_type",
        F.col("value").alias(value),
    )


class _Newest(StatefulProcessor):
    """Keeps a GPU's newest reading and tells nothing; the state itself is the result."""

    def __init__(self, measured: Sequence[str], ttl_millis: int | None):
        self._measured, self._ttl = tuple(measured), ttl_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = T.StructType().add("micros", T.LongType()).add("seq", T.LongType())
        for name in self._measured:
            kept = kept.add(name, T.FloatType())
        self._state = handle.getValueState(_NEWEST, kept, self._ttl)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest = tuple(self._state.get()) if self._state.exists() else None
        before = newest
        for row in rows:
            found = tuple(row[c] for c in ("micros", "seq", *self._measured))
            if newest is None or _nulls_first(found[:2]) > _nulls_first(newest[:2]):
                newest = found
        if newest != before:
            self._state.update(newest)
        yield from ()

    def close(self) -> None:
        pass


_NEWEST = "newest"


def keep_status(
    sdf: DataFrame, checkpoint: str, measured: Sequence[str] = STATUS_METRICS, ttl_seconds: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Keep each GPU's newest reading, by time and ``seq``, in the stream's state; :func:`kept_status` reads it.

    With a TTL a GPU that is silent for so long is forgotten. Nothing else is
    written, so the table of present states is as large as the fleet.
    """
    rows = sdf.select(
        *IDENTITY, F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("float").alias(c) for c in measured],
    )
    ttl = None if ttl_seconds is None else ttl_seconds * 1000
    mode = "None" if ttl is None else "ProcessingTime"
    out = rows.groupBy(*IDENTITY).transformWithState(_Newest(measured, ttl), "nothing string", "Update", mode)
    writer = out.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def kept_status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The newest reading of each GPU, as :func:`keep_status` has it after its last batch; for ``gpu_status``."""
    state = spark.read.format("statestore").option("stateVarName", _NEWEST).load(checkpoint)
    return state.select("key.*", "value.*").select(
        *IDENTITY, F.timestamp_micros("micros").alias("ts"), "seq",
        *[c for c in state.schema["value"].dataType.fieldNames() if c not in ("micros", "seq")],
    )


def change_feed(
    sdf: DataFrame, callback: Callable[[DataFrame, BatchName], None], checkpoint: str,
    interval: str | None = None, **columns: Any,
) -> StreamingQuery:
    """Hand every micro-batch of :func:`change_events` to ``callback(events, batch)``; ``batch`` is its name."""
    return start_batches(change_events(sdf, **columns), callback, checkpoint, interval)
