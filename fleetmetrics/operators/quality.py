"""Splitting off invalid rows and counting errors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_missing_identity(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows without GPU id or host name are rejected.

    Where the reader has already set ``reject_reason``, that reason decides.
    """
    if "reject_reason" not in df.columns:
        blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
        df = df.withColumn(
            "reject_reason",
            F.when(blank("gpu_id") | blank("hostname"), "missing required fields"),
        )
    good = df.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, df.filter(F.col("reject_reason").isNotNull())


def row_errors(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row per failed check: field, value, message."""
    errors = F.array_compact(F.array(*checks.values()))
    return df.select(F.explode(errors).alias("e")).select("e.field", "e.value", "e.message")


def quality_report(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """How often each check failed."""
    return (
        row_errors(df, checks)
        .groupBy("field", "message")
        .agg(F.count(F.lit(1)).alias("n"))
    )
