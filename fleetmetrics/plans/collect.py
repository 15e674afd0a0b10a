"""Messages to stored points, registry and status, in one batch job."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from ..operators.readings import stamp_lineage, upsert_readings
from ..operators.registry import gpu_status, register_gpus, register_hosts
from ..schemas import DEFAULT_CLUSTER, RECORD_WITH_CUSTOM
from ..sources.messages import decode_messages, records_to_readings


@dataclass(frozen=True)
class Collected:
    points: DataFrame
    hosts: DataFrame
    gpus: DataFrame
    malformed: DataFrame


def collect_messages(
    messages: DataFrame, as_of: datetime | str, *, collector_id: str = "collector",
    cluster_id: str = DEFAULT_CLUSTER,
) -> Collected:
    """Decode, keep the last write per GPU and second, and derive hosts, GPUs and status."""
    good, bad = decode_messages(messages, RECORD_WITH_CUSTOM)
    readings = records_to_readings(good, as_of, cluster_id)
    points = stamp_lineage(
        upsert_readings(readings, order=("stream_key",)), collector_id, as_of
    )
    gpus = register_gpus(readings, collector_id, seq="stream_key")
    return Collected(
        points=points,
        hosts=register_hosts(readings, collector_id),
        gpus=gpu_status(gpus, readings),
        malformed=bad,
    )
