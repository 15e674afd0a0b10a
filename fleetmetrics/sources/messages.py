"""Records as queue messages and back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import parse_ts, rfc3339
from ..schemas import METRICS, RECORD
from ..session import instant

# Where messages live, and the lifetime when none is given.
QUEUE_PREFIX = "/telemetry/queue"
DEFAULT_TTL_SECONDS = 3600


def seconds(n: Column | float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n if isinstance(n, Column) else F.lit(n))


def sortable(number: Column) -> Column:
    """A whole number as 19 digits; a negative one sorts before all others, the lowest first."""
    digits = lambda n: F.lpad(n.cast("string"), 19, "0")
    return F.when(number < 0, F.concat(F.lit("!"), digits(number + (2**63 - 1)))).otherwise(digits(number))


def encode_messages(
    df: DataFrame, topic: str, ttl_seconds: int, as_of: datetime | str | Column, *,
    streamer_id: str = "streamer", prefix: str = QUEUE_PREFIX, seq: str | None = "seq",
) -> DataFrame:
    """Wide readings as messages: JSON payload, ordered unique key, headers, expiry.

    Keys sort by publishing time, then by ``seq``, which must be unique; without
    such a column by event time, a custom metric ``seq`` (rows that have none come
    first) and the payload's hash, and rows equal in every field are one message.
    Numbers in keys have a fixed width, so that their order as text is that of the
    numbers.
    """
    created = instant(as_of)
    ttl = ttl_seconds if ttl_seconds > 0 else DEFAULT_TTL_SECONDS
    fields = {
        "timestamp": F.col("_time"),
        **{c: F.col(c) for c in RECORD.fieldNames() if c != "timestamp"},
    }
    names = list(RECORD.fieldNames())
    if "custom_metrics" in df.columns:  # a field of the payload where there are any
        fields["custom_metrics"] = F.when(F.size("custom_metrics") > 0, F.col("custom_metrics"))
        names.append("custom_metrics")
    payload = F.col("_payload")
    numbered = bool(seq) and seq in df.columns
    # Time and payload are made once; everything below refers to them by name.
    df = df.withColumn("_time", rfc3339(F.col("ts"))).withColumn(
        "_payload", F.to_json(F.struct(*[fields[c].alias(c) for c in names]))
    )
    if numbered:
        df = df.withColumn("_number", sortable(F.col(seq))).withColumn("_place", F.col("_number"))
    else:
        moment = sortable(F.unix_micros(F.col("ts").cast("timestamp")))
        # The letter comes after all digits of a hash, which stands there in rows without a seq.
        own = F.concat(F.lit("s"), sortable(F.col("custom_metrics")["seq"].try_cast("long")))
        tie = F.concat_ws("_", own, "_number") if "custom_metrics" in df.columns else F.col("_number")
        df = df.withColumn("_number", F.sha2(payload, 256)).withColumn(
            "_place", F.concat(moment, F.lit("_"), tie)
        )
    number, place = F.col("_number"), F.col("_place")
    message_id = F.concat_ws("_", "hostname", "gpu_id", number)
    nanos = F.unix_micros(created) * 1000
    messages = df.select(
        message_id.alias("message_id"),
        F.lit(topic).alias("topic"),
        F.concat(
            F.lit(f"{prefix}/{topic}/"), sortable(nanos), F.lit("_"), place, F.lit("_"),
            F.concat_ws("_", "hostname", "gpu_id"),
        ).alias("stream_key"),
        F.encode(payload, "UTF-8").alias("payload"),
        F.create_map(
            F.lit("streamer_id"), F.lit(streamer_id),
            F.lit("gpu_id"), F.col("gpu_id"),
            F.lit("hostname"), F.col("hostname"),
            F.lit("timestamp"), fields["timestamp"],
            F.lit("metric_name"), F.lit("telemetry"),
        ).alias("headers"),
        created.alias("created_at"),
        (created + seconds(ttl)).alias("expires_at"),
        F.lit(False).alias("processed"),
        F.lit(0).alias("retries"),
    )
    return messages if numbered else messages.dropDuplicates(["message_id"])


def decode_messages(
    df: DataFrame, schema: T.StructType = RECORD
) -> tuple[DataFrame, DataFrame]:
    """(records, malformed messages with ``bad_payload``).

    A payload must be one JSON object: an empty or blank one, and one with text
    after the object, is malformed. Missing numbers are 0, missing texts empty.
    """
    return split_decoded(parse_messages(df, schema), schema)


# Text whose first closing brace is its end: nothing can follow an object that parsed. What has a list, a single
# quote, or an N or I, of which NaN, INF and Infinity may be made, is left to the slower check.
_PLAIN = r"\A\{[^}'\[NI]*+\}\z"


def parse_messages(df: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """The messages with their payload as ``record``, ``broken`` where it is malformed.

    A job that needs both outcomes keeps this and splits it by :func:`split_decoded`.
    """
    with_bad = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    text = F.col("_text")
    parsed = df.withColumn("_text", F.decode("payload", "UTF-8")).withColumn(
        "record",
        F.from_json(text, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
    )
    # The parser stops after the object. As the one element of an array, text after it shows.
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    whole = F.when(text.rlike(_PLAIN), True).otherwise(F.coalesce(alone & text.rlike(r"\A\s*\{"), F.lit(False)))
    broken = F.col("payload").isNull() | F.col("record").isNull() | F.col("record._bad").isNotNull() | ~whole
    return parsed.withColumn("broken", broken).drop("_text")


def whole_records(parsed: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """The records of :func:`parse_messages`, of which ``record`` and ``broken`` are enough."""

    def field(f: T.StructField) -> Column:
        value = F.col(f"record.{f.name}")
        if isinstance(f.dataType, T.StringType):
            value = F.coalesce(value, F.lit(""))
        elif isinstance(f.dataType, T.NumericType):
            value = F.coalesce(value, F.lit(0).cast(f.dataType))
        return value.alias(f.name)

    kept = [c for c in ("message_id", "topic", "stream_key", "created_at") if c in parsed.columns]
    return parsed.filter(~F.col("broken")).select(*kept, *map(field, schema.fields))


def split_decoded(parsed: DataFrame, schema: T.StructType = RECORD) -> tuple[DataFrame, DataFrame]:
    """(records, malformed messages) of :func:`parse_messages`."""
    text = F.coalesce(F.decode("payload", "UTF-8"), F.lit(""))
    bad = parsed.filter("broken").withColumn("bad_payload", text)
    return whole_records(parsed, schema), bad.drop("record", "broken")


def records_to_readings(records: DataFrame, as_of, cluster_id: str) -> DataFrame:
    """Decoded records as wide readings."""
    return records.select(
        parse_ts(F.col("timestamp"), as_of).alias("ts"),
        F.lit(cluster_id).alias("cluster_id"),
        "hostname", "gpu_id", "uuid", "device", "model_name", *METRICS,
        *[c for c in ("stream_key", "custom_metrics") if c in records.columns],
    )
