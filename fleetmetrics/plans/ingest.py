"""CSV files to messages, in one batch job."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.quality import drop_missing_identity
from ..sources.csv_files import read_readings_csv
from ..sources.messages import encode_messages


@dataclass(frozen=True)
class Ingested:
    messages: DataFrame
    good: DataFrame
    rejected: DataFrame


def ingest_folder(
    spark: SparkSession, path: str, as_of: datetime | str, *, topic: str = "telemetry",
    ttl_seconds: int = 3600, timestamp_mode: str = "event", custom_metrics: bool = True,
) -> Ingested:
    """Read, clean and check the wide and long files of a folder and encode the good rows.

    Finite numbers in columns that no metric is named by are custom metrics.
    """
    rows = read_readings_csv(spark, path, as_of, timestamp_mode=timestamp_mode, custom_metrics=custom_metrics)
    good, rejected = drop_missing_identity(rows)
    return Ingested(encode_messages(good, topic, ttl_seconds, as_of), good, rejected)
