"""Every registered query against its SQL twin on the smallest tables."""

import ast
from datetime import datetime, timedelta
from pathlib import Path

import pytest

import __spark_entry__ as entry
import checks.compare
import checks.entries
import checks.oracles
import checks.testmap
from checks.compare import database, differences
from checks.entries import QUERIES
from checks.oracles import ORACLES
from checks.testmap import EVENTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert differences(spark, db, name, SF) is None


@pytest.mark.parametrize("module", [checks.entries, checks.oracles, checks.testmap, checks.compare])
def test_no_name_is_defined_twice(module):
    """The later one would replace the earlier one in all its uses."""
    body = ast.parse(Path(module.__file__).read_text()).body
    names = [n.name for n in body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
    assert sorted(set(names)) == sorted(names)


def events(spark, tmp_path, rows) -> str:
    """A folder with an ``events`` table of (event_id, second, user_id, event_type, value)."""
    at = lambda second: datetime(2024, 1, 5) + timedelta(seconds=second)
    data = [(i, at(second), user, kind, value, "{}") for i, second, user, kind, value in rows]
    spark.createDataFrame(data, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_custom_metrics_takes_the_last_seq_of_a_second(spark, tmp_path):
    """Whatever the event times within the second and the other values are; GPUs and seconds apart stay apart."""
    rows = [(i, 0.01 * i, 17, "click", 90.0 - i) for i in range(1, 12)]
    rows += [(20, 1.0, 17, "view", 8.0), (21, 0.2, 16, "error", 7.0), (22, 0.0, 25, "click", 1.0)]
    got = QUERIES["custom_metrics"](spark, events(spark, tmp_path, rows)).collect()
    second = 1704412800
    assert sorted((r.telemetry_id, r.seq) for r in got) == [
        (f"gpu-node-00002_0_{second}", 21), (f"gpu-node-00002_1_{second}", 11), (f"gpu-node-00002_1_{second + 1}", 20),
    ]


def test_ingest_folder_job_sends_every_row_that_has_a_host(spark, tmp_path):
    """From files of both formats; a reading whose metrics are all below 5 lacks its host there."""
    rows = [(1, 0.5, 17, "click", 90.0), (2, 0.7, 17, "purchase", 7.5), (3, 61.0, 16, "error", 8192.0),
            (4, 0.0, 25, "view", 4.5), (5, 3.0, 24, "signup", 5.0)]
    got = QUERIES["ingest_folder_job"](spark, events(spark, tmp_path, rows)).collect()
    measured = ("gpu_utilization", "power_draw", "memory_used_mb", "temperature")
    assert sorted((r.timestamp, r.hostname, r.gpu_id, r.uuid, *[r[m] for m in measured]) for r in got) == [
        ("2024-01-05T00:00:00Z", "gpu-node-00002", "1", "GPU-00000017", 0.0, 7.5, 0.0, 0.0),
        ("2024-01-05T00:00:00Z", "gpu-node-00002", "1", "GPU-00000017", 90.0, 0.0, 0.0, 0.0),
        ("2024-01-05T00:00:03Z", "gpu-node-00003", "0", "GPU-00000024", 0.0, 0.0, 0.0, 5.0),
        ("2024-01-05T00:01:01Z", "gpu-node-00002", "0", "GPU-00000016", 0.0, 0.0, 8192.0, 0.0),
    ]


def test_ingest_long_folder_sends_a_reading_per_gpu_and_second(spark, tmp_path):
    """With each metric of the second, and none left out."""
    rows = [(1, 0.1, 17, "click", 90.0), (2, 0.4, 17, "purchase", 7.5), (3, 0.9, 17, "view", 3.0),
            (4, 1.0, 17, "click", 1.25), (5, 0.2, 25, "signup", 41.0), (6, 0.3, 16, "error", 0.0)]
    got = QUERIES["ingest_long_folder"](spark, events(spark, tmp_path, rows)).collect()
    measured = ("gpu_utilization", "memory_utilization", "power_draw", "temperature", "memory_used_mb")
    assert sorted((r.timestamp, r.hostname, r.gpu_id, r.uuid, *[r[m] for m in measured]) for r in got) == [
        ("2024-01-05T00:00:00Z", "gpu-node-00002", "0", "GPU-00000016", 0.0, 0.0, 0.0, 0.0, 0.0),
        ("2024-01-05T00:00:00Z", "gpu-node-00002", "1", "GPU-00000017", 90.0, 3.0, 7.5, 0.0, 0.0),
        ("2024-01-05T00:00:00Z", "gpu-node-00003", "1", "GPU-00000025", 0.0, 0.0, 0.0, 41.0, 0.0),
        ("2024-01-05T00:00:01Z", "gpu-node-00002", "1", "GPU-00000017", 1.25, 0.0, 0.0, 0.0, 0.0),
    ]
