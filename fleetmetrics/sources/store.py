"""The readings table, key-value dumps and batch envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import classify_key
from ..schemas import CLUSTER, GPU, HOST, READING_BATCH, STORED_POINT

SORT_WITHIN_FILE = ("hostname", "gpu_id", "ts")


def write_readings(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write below ``cluster_id``/``event_date``, sorted by host, GPU and time inside files.

    The rebalance lets adaptive execution split a cluster-day that is too big
    for one task and join up those that are too small.
    """
    parts = ("cluster_id", "event_date")
    (
        df.withColumn("event_date", F.to_date("ts"))
        .hint("rebalance", *parts)
        .sortWithinPartitions(*parts, *SORT_WITHIN_FILE)
        .write.mode(mode)
        .partitionBy(*parts)
        .parquet(path)
    )


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """The table of :func:`write_readings`; clusters are text, whatever their names look like."""
    found = spark.read.parquet(path)
    if isinstance(found.schema["cluster_id"].dataType, T.StringType):
        return found
    fields = [T.StructField(f.name, T.StringType()) if f.name == "cluster_id" else f for f in found.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


#: The kinds of values in a dump: their shape, and which columns their key gives.
_KINDS = {
    "cluster": (CLUSTER, {"cluster_id": "cluster"}),
    "host": (HOST, {"cluster_id": "cluster", "hostname": "host"}),
    "gpu": (GPU, {"cluster_id": "cluster", "hostname": "host", "gpu_id": "gpu"}),
    "data": (STORED_POINT, {"cluster_id": "cluster", "hostname": "host", "gpu_id": "gpu", "telemetry_id": "point"}),
}


def parse_kv_dump(df: DataFrame) -> DataFrame:
    """The dump with the parts of each key as ``k``, and each value parsed by its kind, in one pass.

    A value is in the column of its kind; ``whole`` tells whether it is JSON of
    that shape, NULL for keys of other kinds. A job that wants several kinds, or
    the broken values too, keeps this and takes it apart by :func:`kv_documents`
    and :func:`broken_documents`.
    """
    typed = df.select("key", classify_key(F.col("key")).alias("k"), "value")
    kind = F.col("k.kind")
    parsed = typed.select(
        "*", *[F.when(kind == name, _document(schema)).alias(name) for name, (schema, _) in _KINDS.items()]
    )
    whole = F.lit(None).cast("boolean")
    for name in _KINDS:
        whole = F.when(kind == name, F.coalesce(_whole(name), F.lit(False))).otherwise(whole)
    return parsed.withColumn("whole", whole)


def kv_documents(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(clusters, hosts, gpus, points) of :func:`parse_kv_dump`."""

    def documents(name: str) -> DataFrame:
        schema, where = _KINDS[name]
        own = [c for c in schema.fieldNames() if c not in where]
        return parsed.filter((F.col("k.kind") == name) & F.col("whole")).select(
            *[F.col(f"k.{part}").alias(column) for column, part in where.items()],
            *[F.col(f"{name}.{c}").alias(c) for c in own],
        )

    return tuple(documents(name) for name in _KINDS)


def broken_documents(parsed: DataFrame) -> DataFrame:
    """(key, kind, value) of the documents of :func:`parse_kv_dump` that are not JSON of their kind's shape."""
    return parsed.filter(~F.col("whole")).select("key", F.col("k.kind").alias("kind"), "value")


def import_kv_dump(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(clusters, hosts, gpus, points) of a dump of key and JSON value.

    The key says what a value is and where it belongs; values that are not JSON
    of that shape are left out here and listed by :func:`broken_kv_values`.
    """
    return kv_documents(parse_kv_dump(df))


def _document(schema: T.StructType):
    with_bad = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    return F.from_json("value", with_bad, {"columnNameOfCorruptRecord": "_bad"})


def _whole(column: str):
    return F.col(column).isNotNull() & F.col(f"{column}._bad").isNull()


def broken_kv_values(df: DataFrame) -> DataFrame:
    """(key, kind, value) of a dump's documents whose value is not JSON of their kind's shape."""
    return broken_documents(parse_kv_dump(df))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Batch envelopes stored as JSON lines."""
    return spark.read.schema(READING_BATCH).json(path)


def explode_batches(df: DataFrame) -> DataFrame:
    """One row per data point, with the id and time of its batch."""
    return df.select(
        "batch_id", "batch_timestamp", F.explode("data_points").alias("p")
    ).select("batch_id", "batch_timestamp", "p.*")
