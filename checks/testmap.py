"""The ``events`` table seen as readings, messages, heartbeats, metrics and change logs.

Each function has a twin of the same name among the common table expressions
in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmetrics.schemas import METRICS
from fleetmetrics.sources.messages import QUEUE_PREFIX, seconds

AS_OF = "2024-01-31T00:00:00Z"

# Which metric an event of a type stands for.
EVENT_METRICS = {
    "click": "gpu_utilization",
    "view": "memory_utilization",
    "signup": "temperature",
    "purchase": "power_draw",
    "error": "memory_used_mb",
}


EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table under its known schema, which saves the job that would look for it."""
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def _number(col: str) -> Column:
    return F.col(col).cast("string")


def _host(user: str = "user_id") -> Column:
    return F.expr(f"concat('gpu-node-', lpad(cast({user} div 8 as string), 5, '0'))")


def identity() -> list[Column]:
    return [
        F.expr("concat('cluster-', cast((user_id div 8) % 3 as string))").alias("cluster_id"),
        _host().alias("hostname"),
        F.expr("cast(user_id % 8 as string)").alias("gpu_id"),
        F.expr("concat('nvidia', cast(user_id % 8 as string))").alias("device"),
        F.expr("concat('GPU-', lpad(cast(user_id as string), 8, '0'))").alias("uuid"),
        F.when(F.col("user_id") % 2 == 0, "H100").otherwise("A100").alias("model_name"),
    ]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric per row."""
    metric = F.coalesce(
        *[F.when(F.col("event_type") == e, m) for e, m in EVENT_METRICS.items()]
    )
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "ts", *identity(), metric.alias("metric_name"),
        "value", F.col("props").alias("labels_raw"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; the metrics it does not stand for are 0."""
    of = {m: e for e, m in EVENT_METRICS.items()}

    def metric(m: str) -> Column:
        if m not in of:
            return F.lit(0.0).cast("float").alias(m)
        value = F.when(F.col("event_type") == of[m], F.col("value")).otherwise(0.0)
        return value.cast("float").alias(m)

    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "ts", *identity(), *map(metric, METRICS)
    )


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wide reading written twice, the second time with other values."""
    first = wide(spark, sf_dir)
    later = first.withColumn("seq", F.col("seq") + 10_000_000).withColumn(
        "power_draw", (F.col("power_draw") + 1).cast("float")
    )
    return first.unionByName(later)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a message of the topic of its type, living ``value`` hours."""
    hours = F.floor("value").cast("int") * 3600
    message_id = F.concat(F.lit("m-"), _number("event_id"))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        message_id.alias("message_id"),
        F.col("event_type").alias("topic"),
        F.concat(
            F.lit(f"{QUEUE_PREFIX}/"), "event_type", F.lit("/"), F.lpad(_number("event_id"), 12, "0")
        ).alias("stream_key"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + seconds(hours)).alias("expires_at"),
        "user_id",
    )


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap events were acknowledged after a day; dear errors under an id nobody sent."""
    known = F.col("value") < 20
    return (
        events(spark, sf_dir)
        .filter(known | ((F.col("value") >= 100) & (F.col("event_type") == "error")))
        .select(
            F.concat(F.when(known, "m-").otherwise("lost-"), _number("event_id")).alias("message_id"),
            F.col("event_type").alias("topic"),
            F.concat(F.lit("consumer-"), _number("user_id")).alias("consumer_id"),
            (F.col("ts") + F.expr("interval 1 day")).alias("acked_at"),
        )
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = F.expr("element_at(array('collector', 'gateway', 'streamer'), cast(user_id % 3 as int) + 1)")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), service.alias("service_type"),
        F.concat(F.lit("i-"), _number("user_id")).alias("instance_id"), "ts",
        F.when(F.col("event_type") == "error", "unhealthy")
        .when(F.col("event_type") == "view", "").otherwise("healthy").alias("health"),
    )


def _service() -> Column:
    return F.concat(F.lit("svc-"), "event_type")


# How much a service's load is scaled down.
LOAD_DIVISORS = {"click": 5.0, "view": 50.0, "signup": 250.0, "purchase": 900.0}


def instance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads that differ by service; ``svc-view`` reported ten days earlier and is silent now."""
    divisor = F.coalesce(
        *[F.when(F.col("event_type") == e, F.lit(d)) for e, d in LOAD_DIVISORS.items()], F.lit(500.0)
    )
    earlier = F.when(F.col("event_type") == "view", F.col("ts") - F.expr("interval 10 days")).otherwise(F.col("ts"))
    return (
        events(spark, sf_dir)
        .withColumn("ts", earlier)
        .select(
            F.col("event_id").alias("seq"), "ts", _service().alias("service_type"),
            F.concat(F.lit("i-"), _number("user_id")).alias("instance_id"),
            F.least(F.col("value") / divisor, F.lit(1.0)).alias("cpu_usage"),
            F.least(F.col("value") / (divisor * 2), F.lit(1.0)).alias("memory_usage"),
            (F.col("value") * 25 / divisor).alias("queue_depth"),
            F.when(F.col("value") > 80, "unhealthy").otherwise("healthy").alias("health"),
        )
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past decisions of two services."""
    return (
        events(spark, sf_dir)
        .filter(F.col("event_type").isin("purchase", "click"))
        .select(
            _service().alias("service_type"),
            F.when(F.col("event_type") == "click", "no_action")
            .when(F.col("value") > 15, "scale_up").otherwise("scale_down").alias("action"),
            "ts",
        )
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of every service, with room for as many instances as there are users."""
    return (
        events(spark, sf_dir)
        .groupBy(_service().alias("service_type"))
        .agg((F.count_distinct("user_id") + 1).alias("max_instances"))
        .select(
            "service_type",
            F.lit(1).alias("min_instances"), "max_instances",
            F.lit(0.8).alias("scale_up_threshold"), F.lit(0.3).alias("scale_down_threshold"),
            F.lit(14400).alias("cooldown_seconds"),
            F.lit(0.3).alias("weight_cpu"), F.lit(0.3).alias("weight_memory"),
            F.lit(0.4).alias("weight_queue"),
        )
    )


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each GPU's document, put by most events and deleted by errors."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("gpu-"), _number("user_id")).alias("key"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"),
        F.col("props").alias("value"), "ts",
    )


def config_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog(spark, sf_dir).withColumnRenamed("op", "type")


def config_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .select(F.concat(F.lit("gpu-"), _number("user_id")).alias("key"))
        .distinct()
        .withColumn("value", F.lit('{"k": -1}'))
    )


def snapshot(spark: SparkSession, sf_dir: str, start: str, end: str) -> DataFrame:
    """The last value of each GPU's metrics within some days."""
    days = readings(spark, sf_dir).filter(
        (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    )
    return (
        days.groupBy("hostname", "gpu_id", "metric_name")
        .agg(F.max_by(F.round("value", 0), "seq").alias("value"))
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query arguments of every kind, good and bad, made from the events' fields."""
    user, kind = F.col("user_id"), F.col("event_type")
    gpu = (
        F.when(user % 8 == 0, "").when(user % 8 == 1, F.concat(F.lit("gpu@"), _number("user_id")))
        .when(user % 8 == 2, F.repeat(F.lit("g"), 101)).when(user % 8 == 3, "gpu-0\n")
        .otherwise(F.concat(F.lit("GPU_"), _number("user_id")))
    )
    host = (
        F.when(user % 8 == 4, "").when(user % 8 == 5, "-invalid").when(user % 8 == 6, "x")
        .when(user % 8 == 7, F.repeat(F.lit("h"), 254))
        .otherwise(F.concat(F.lit("node-"), _number("user_id"), F.lit(".example.com")))
    )
    cluster = (
        F.when(kind == "error", "cluster@1").when(kind == "view", "")
        .when(kind == "signup", F.repeat(F.lit("c"), 51)).otherwise("prod-1")
    )
    limit = (
        F.when(kind == "click", "").when(kind == "error", "abc").when(kind == "view", "0")
        .when(kind == "signup", F.floor("value").cast("string"))
        .otherwise(F.floor(F.col("value") * 100).cast("string"))
    )
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    start = F.when(kind == "error", "yesterday").when(
        kind == "view", iso(F.col("ts") - F.expr("interval 750 days"))
    ).otherwise(iso(F.col("ts")))
    end = (
        F.when(kind == "click", iso(F.col("ts") + F.expr("interval 31 days")))
        .when(kind == "purchase", iso(F.col("ts") - F.expr("interval 1 hour")))
        .when(kind == "signup", "").otherwise("soon")
    )
    return events(spark, sf_dir).select(
        gpu.alias("gpu_id"), host.alias("hostname"), cluster.alias("cluster_id"),
        start.alias("start_time"), end.alias("end_time"), limit.alias("limit"),
    )
