"""Row shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The metric columns of a wide reading, all 32-bit floats.
METRICS = (
    "gpu_utilization",
    "memory_utilization",
    "memory_used_mb",
    "memory_free_mb",
    "temperature",
    "power_draw",
    "sm_clock_mhz",
    "memory_clock_mhz",
)

# What names a GPU, and what describes it.
IDENTITY = ("cluster_id", "hostname", "gpu_id")
ATTRIBUTES = ("uuid", "device", "model_name")

# Columns a wide file must have.
REQUIRED_COLUMNS = ("timestamp", "gpu_id", "hostname")

DEFAULT_CLUSTER = "default-cluster"

_S, _F, _TS = T.StringType(), T.FloatType(), T.TimestampType()
_TAGS = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# The JSON record a message carries.
RECORD = _struct(
    timestamp=_S, gpu_id=_S, uuid=_S, device=_S, model_name=_S, hostname=_S,
    **{m: _F for m in METRICS},
)

# The same with what other numbers a file held.
RECORD_WITH_CUSTOM = T.StructType([*RECORD, T.StructField("custom_metrics", T.MapType(_S, _F))])

# One metric per row.
LONG_READING = _struct(
    timestamp=_TS, metric_name=_S, gpu_id=_S, device=_S, uuid=_S, model_name=_S,
    hostname=_S, container=_S, pod=_S, namespace=_S, value=T.DoubleType(), labels_raw=_S,
)

# A batch of long readings.
READING_BATCH = _struct(
    data_points=T.ArrayType(LONG_READING), batch_id=_S, batch_timestamp=_TS,
)

# A stored point.
STORED_POINT = _struct(
    telemetry_id=_S, timestamp=_TS, gpu_id=_S, uuid=_S, device=_S, model_name=_S,
    hostname=_S, **{m: _F for m in METRICS},
    custom_metrics=T.MapType(T.StringType(), _F),
    collected_at=_TS, processed_at=_TS, collector_id=_S, batch_id=_S,
)

GPU_STATUS = _struct(
    state=_S, utilization_percent=_F, memory_used_percent=_F, temperature_celsius=_F,
    power_draw_watts=_F, healthy=T.BooleanType(), last_updated=_TS,
)
HOST_STATUS = _struct(
    state=_S, healthy=T.BooleanType(), last_seen=_TS, health_checks=_TAGS,
)
CLUSTER_METADATA = _struct(
    total_hosts=T.IntegerType(), total_gpus=T.IntegerType(), active_hosts=T.IntegerType(),
    active_gpus=T.IntegerType(), last_updated=_TS, configuration=_TAGS,
)

CLUSTER = _struct(
    cluster_id=_S, cluster_name=_S, region=_S, environment=_S, labels=_TAGS,
    created_at=_TS, updated_at=_TS, metadata=CLUSTER_METADATA,
)
HOST = _struct(
    host_id=_S, hostname=_S, ip_address=_S, os_version=_S, labels=_TAGS,
    created_at=_TS, updated_at=_TS, status=HOST_STATUS,
)
GPU = _struct(
    gpu_id=_S, uuid=_S, device=_S, device_name=_S, driver_version=_S, cuda_version=_S,
    memory_total_mb=T.IntegerType(), properties=_TAGS, created_at=_TS, updated_at=_TS,
    status=GPU_STATUS,
)

MESSAGE = _struct(
    message_id=_S, topic=_S, stream_key=_S, payload=T.BinaryType(), headers=_TAGS,
    created_at=_TS, expires_at=_TS, processed=T.BooleanType(), retries=T.IntegerType(),
)

ERROR = _struct(field=_S, value=_S, message=_S)
