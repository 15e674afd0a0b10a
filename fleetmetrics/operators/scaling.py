"""Instance load and the recommended number of instances per service."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import DEFAULT_WEIGHTS, instance_load
from ..session import instant, instant_for, utc
from ..sources.messages import seconds

# Rules of a service without rules of its own.
DEFAULT_RULES = {
    "min_instances": 1,
    "max_instances": 10,
    "scale_up_threshold": 0.8,
    "scale_down_threshold": 0.3,
    "cooldown_seconds": 300,
    "weight_cpu": DEFAULT_WEIGHTS["cpu"],
    "weight_memory": DEFAULT_WEIGHTS["memory"],
    "weight_queue": DEFAULT_WEIGHTS["queue"],
}

# Age limit of metrics, and confidences of the fixed decisions. The reason texts in
# scaling_decisions are fixed values too.
MAX_AGE = timedelta(minutes=2)
NO_DATA_CONFIDENCE, COOLDOWN_CONFIDENCE, STEADY_CONFIDENCE = 0.5, 0.8, 0.9


def default_rules(services: DataFrame) -> DataFrame:
    """Default rules for each distinct ``service_type``."""
    return services.select("service_type").distinct().withColumns(
        {name: F.lit(value) for name, value in DEFAULT_RULES.items()}
    )


def latest_instance_metrics(metrics: DataFrame) -> DataFrame:
    """The current row per service and instance."""
    keys = ("service_type", "instance_id")
    rest = [c for c in metrics.columns if c not in keys]
    order = F.struct(*[c for c in ("ts", "seq") if c in rest])
    return (
        metrics.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, "_row.*")
    )


def fresh_metrics(
    metrics: DataFrame, as_of: datetime | str, max_age: timedelta = MAX_AGE
) -> DataFrame:
    return metrics.filter(F.col("ts") >= instant_for(metrics, "ts", utc(as_of) - max_age))


def _fresh_instances(
    metrics: DataFrame, as_of: datetime | str, max_age: timedelta
) -> DataFrame:
    # An instance's newest row is fresh exactly if any of its rows is, so the
    # age filter may run first and reach the reader.
    return latest_instance_metrics(fresh_metrics(metrics, as_of, max_age))


def service_load(
    metrics: DataFrame, as_of: datetime | str, weights: Mapping[str, float] | None = None,
    max_age: timedelta = MAX_AGE,
) -> DataFrame:
    """Per service: mean load, instances and healthy instances; 0 if none is fresh."""
    known = metrics.select("service_type").distinct()
    loads = _fresh_instances(metrics, as_of, max_age).groupBy("service_type").agg(
        F.avg(instance_load(weights)).alias("load"),
        F.count(F.lit(1)).alias("instance_count"),
        F.count_if(F.col("health") == "healthy").alias("healthy_count"),
    )
    return known.join(loads, "service_type", "left").na.fill(0)


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The newest published decision per service."""
    return (
        decisions.groupBy("service_type")
        .agg(F.max_by(F.struct("action", "ts"), "ts").alias("_d"))
        .select("service_type", "_d.*")
    )


def in_cooldown(rules: DataFrame, decisions: DataFrame, as_of: datetime | str) -> DataFrame:
    """Per service, whether its last decision acted and is younger than the cooldown."""
    last = last_decisions(decisions).select(
        "service_type", F.col("action").alias("_action"), F.col("ts").cast("timestamp").alias("_at")
    )
    acting = (F.col("_action") != "no_action") & (
        instant(as_of) < F.col("_at") + seconds(F.col("cooldown_seconds"))
    )
    return rules.join(last, "service_type", "left").select(
        "service_type", F.coalesce(acting, F.lit(False)).alias("in_cooldown")
    )


def scaling_decisions(
    metrics: DataFrame, decisions: DataFrame, rules: DataFrame, as_of: datetime | str,
    max_age: timedelta = MAX_AGE,
) -> DataFrame:
    """One recommendation for every service in ``rules``."""
    known = metrics.select("service_type").distinct().withColumn("_known", F.lit(True))
    full = F.least(F.col("queue_depth") / 100.0, F.lit(1.0))
    fresh = _fresh_instances(metrics, as_of, max_age).groupBy("service_type").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("cpu_usage").alias("_cpu"),
        F.avg("memory_usage").alias("_memory"),
        F.avg(full).alias("_queue"),
    )
    load = (
        F.col("_cpu") * F.col("weight_cpu")
        + F.col("_memory") * F.col("weight_memory")
        + F.col("_queue") * F.col("weight_queue")
    )
    joined = (
        rules.join(known, "service_type", "left")
        .join(fresh, "service_type", "left")
        .join(in_cooldown(rules, decisions, as_of), "service_type", "left")
        .withColumn("_load", load)
        .withColumn("_n", F.coalesce("_n", F.lit(0)))
    )
    n, load = F.col("_n"), F.col("_load")
    up, down = F.col("scale_up_threshold"), F.col("scale_down_threshold")
    one = F.lit(1.0)

    def say(text: str, *values):
        return F.format_string(text, *[v * 100 for v in values])

    def decision(action, count, reason, confidence):
        return F.struct(
            F.lit(action).alias("action"),
            count.cast("int").alias("recommended_count"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
            confidence.alias("confidence"),
        )

    sure = lambda ratio: F.least(F.coalesce(ratio, one), one)
    least = F.col("min_instances")
    verdict = (
        F.when(
            F.col("_known").isNull(),
            decision("no_action", least, "no metrics available", F.lit(NO_DATA_CONFIDENCE)),
        )
        .when(
            n == 0,
            decision("no_action", least, "no recent metrics available", F.lit(NO_DATA_CONFIDENCE)),
        )
        .when(
            F.col("in_cooldown"),
            decision("no_action", n, "in cooldown period", F.lit(COOLDOWN_CONFIDENCE)),
        )
        .when(
            (load > up) & (n < F.col("max_instances")),
            decision(
                "scale_up", n + 1, say("high load detected: %.2f%% > %.2f%%", load, up),
                sure(F.try_divide(load, up)),
            ),
        )
        .when(
            (load < down) & (n > least),
            decision(
                "scale_down", n - 1, say("low load detected: %.2f%% < %.2f%%", load, down),
                sure(F.try_divide(down, load)),
            ),
        )
        .otherwise(
            decision(
                "no_action", n, say("load within acceptable range: %.2f%%", load),
                F.lit(STEADY_CONFIDENCE),
            )
        )
    )
    return joined.select(
        "service_type", n.cast("int").alias("current_count"), verdict.alias("_v"),
        instant(as_of).alias("ts"),
    ).select("service_type", "current_count", "_v.*", "ts")


def publish_decisions(df: DataFrame, path: str) -> None:
    """Append decisions; :func:`last_decisions` of the table feeds the next cooldown."""
    df.write.mode("append").parquet(path)
