"""Time the headline queries: one warm-up, then the median of three runs each.

Prints one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the
cores, ``BENCH_RUNS`` the timed runs, ``BENCH_QUERIES`` a list of names.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from checks.entries import QUERIES
from fleetmetrics.session import CHECKPOINT_CONF, build_session

HEADLINE = (
    "readings_by_gpu_api telemetry_by_gpu latest_readings long_to_wide upsert_last_write "
    "gpu_status register_gpus list_gpus fleet_tree cluster_metadata cluster_stats "
    "hosts_with_gpu_count windowed_utilisation reconcile_counts missing_readings quality_report "
    "encode_messages decode_messages consume_many claim_remaining topic_stats queue_totals "
    "pack_batches classify_changes current_config snapshot_diff scaling_decisions "
    "live_services_now throttle_batch read_wide_csv read_long_csv write_readings "
    "run_ingest_stream run_collect_stream windowed_utilisation_stream"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        f"local[{cpus}]",
        **{
            CHECKPOINT_CONF: scratch,
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    sent = {"run_collect_stream": 2 * rows}  # every reading is sent twice
    ingest = {n: round(sent.get(n, rows) / seconds[n]) for n in names if n in (
        "read_wide_csv", "read_long_csv", "run_ingest_stream", "run_collect_stream")}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": int(cpus),
                "timed_runs": runs,
                "events": rows,
                "rows_per_second": ingest,
            }
        )
    )


if __name__ == "__main__":
    main()
