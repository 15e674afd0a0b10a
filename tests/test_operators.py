import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetmetrics.operators import batching, changes, queue, readings as R, registry as G
from fleetmetrics.operators import rollups as A
from fleetmetrics.operators import scaling as S
from fleetmetrics.operators.services import live_services
from fleetmetrics.operators.throttle import Bucket, throttle_flags
from fleetmetrics.operators.topn import first_n_per_key
from fleetmetrics.plans.query import ReadingQuery, readings_by_gpu
from fleetmetrics.schemas import METRICS, RECORD_WITH_CUSTOM
from fleetmetrics.sources import messages

T0 = datetime(2024, 1, 1, 12)
WIDE = "seq long, ts timestamp_ntz, cluster_id string, hostname string, gpu_id string, uuid string, " \
       "device string, model_name string, " + ", ".join(f"{m} float" for m in METRICS)


def reading(seq, minute=0, gpu="0", host="h1", cluster="c1", uuid=None, temp=50.0, util=10.0):
    metrics = {m: 0.0 for m in METRICS} | {"temperature": temp, "gpu_utilization": util}
    return (seq, T0 + timedelta(minutes=minute), cluster, host, gpu,
            f"GPU-{host}-{gpu}" if uuid is None else uuid, "nvidia0", "V100", *metrics.values())


@pytest.fixture(scope="module")
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), WIDE)


def test_match_gpu(frame):
    df = frame(reading(1, gpu="gpu-0", uuid="a"), reading(2, gpu="gpu-0-uuid-12345", uuid="b"),
               reading(3, gpu="gpu-1", uuid="c"), reading(4, gpu="", uuid=""),
               reading(5, gpu="GPU-0", uuid="d"), reading(6, gpu="9", uuid="x-gpu-0"))
    assert {r.seq for r in R.match_gpu(df, "gpu-0").collect()} == {1, 2, 6}
    assert {r.seq for r in R.match_gpu(df, "gpu-0", exact=True).collect()} == {1}
    assert {r.seq for r in R.match_gpu(df, "").collect()} == {1, 2, 3, 5, 6}


def test_time_range_has_whole_second_precision(spark):
    times = ["11:59:59.9", "12:00:00", "12:00:00.5", "12:00:01.999", "12:00:02"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(
        "t", F.concat(F.lit("2024-01-01 "), "t").cast("timestamp_ntz").alias("ts"))
    pick = lambda a, b: [r.t for r in R.time_range(df, a, b).collect()]
    assert pick("2024-01-01T12:00:00Z", "2024-01-01T12:00:01Z") == times[1:4]
    assert pick("2024-01-01T12:00:00.4Z", None) == times[3:]
    assert pick(None, "2024-01-01T13:00:00.7+01:00") == times[:3]
    assert pick(None, None) == times


def test_newest_and_oldest_first(frame):
    df = frame(*[reading(i, m) for i, m in enumerate([120, 240, 0, 180])])
    assert [r.seq for r in R.newest_first(df, 10).collect()] == [1, 3, 0, 2]
    assert [r.seq for r in R.newest_first(df, 2).collect()] == [1, 3]
    assert [r.seq for r in R.oldest_first(df).collect()] == [2, 0, 3, 1]
    assert [r.seq for r in R.oldest_first(df, 1).collect()] == [2]


def test_main_query(frame):
    df = frame(reading(1, 0), reading(2, 1), reading(3, 2, gpu="1"))
    out = readings_by_gpu(df, ReadingQuery(" h1-0\x00 ", limit="5"), "2024-01-02").collect()
    assert [r.timestamp for r in out] == ["2024-01-01T12:01:00Z", "2024-01-01T12:00:00Z"]
    assert list(out[0].asDict()) == list(R.API_COLUMNS)
    with pytest.raises(ValueError, match="cannot exceed 1000"):
        readings_by_gpu(df, ReadingQuery("0", limit="1001"), "2024-01-02", max_limit=1000)
    many = df.crossJoin(df.sparkSession.range(1500))
    assert readings_by_gpu(many, ReadingQuery("h1-0"), "2024-01-02").count() == 3000


def test_filters_and_gpu_metrics(frame):
    df = frame(reading(1, 0), reading(2, 1), reading(3, 2, host="h2"))
    assert [r.seq for r in R.filter_readings(df, host="h1", limit=1).collect()] == [2]
    assert [r.seq for r in R.gpu_metrics(df, "c1", "h1", "0", limit=1).collect()] == [1]


def test_upsert_keeps_the_last_write_per_second(spark, frame):
    df = frame(reading(1, temp=1.0), reading(3, temp=3.0), reading(2, temp=2.0),
               reading(4, cluster="c2", temp=9.0))
    assert sorted(r.temperature for r in R.upsert_readings(df).collect()) == [3.0, 9.0]
    # Without an order the outcome is still fixed, whatever the partitioning.
    unordered = df.drop("seq").withColumn("labels", F.create_map(F.lit("a"), F.lit("b")))
    outcomes = {
        tuple(sorted(r.temperature for r in R.upsert_readings(unordered.repartition(n)).collect()))
        for n in (1, 2, 5)}
    assert outcomes == {(3.0, 9.0)}


def test_long_and_wide(spark):
    rows = [("DCGM_FI_DEV_GPU_UTIL", 1.0, 1), ("DCGM_FI_DEV_GPU_UTIL", 2.0, 3), ("OTHER", 7.0, 4),
            ("DCGM_FI_DEV_GPU_TEMP", 70.0, 2)]
    df = spark.createDataFrame(rows, "metric_name string, value double, seq long").selectExpr(
        "*", "timestamp_ntz'2024-01-01 00:00:00.3' as ts", "'c' as cluster_id", "'h' as hostname",
        "'0' as gpu_id", "'u' as uuid", "'d' as device", "'m' as model_name")
    wide = R.long_to_wide(df)
    row = wide.first()
    assert (row.gpu_utilization, row.temperature, row.power_draw, wide.count()) == (2.0, 70.0, 0.0, 1)
    times = df.filter("seq in (1, 3)").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq / 10)"))
    values = times.drop("seq").withColumn("value", F.lit(10.0) - F.col("value"))
    assert R.long_to_wide(values).first().gpu_utilization == 8.0  # the later, not the greater
    back = {r.metric_name: r.value for r in R.wide_to_long(wide).collect()}
    assert back["temperature"] == 70.0 and len(back) == len(METRICS)


def test_pages(frame):
    df = frame(*[reading(i, i) for i in range(10)])
    page = R.page(df, [F.desc("ts")], limit=3, offset=3)
    assert [r.seq for r in page.rows.collect()] == [6, 5, 4]
    assert tuple(page.summary.first()) == (10, True)
    assert tuple(R.page(df, ["seq"], 5, 5).summary.first()) == (10, False)
    assert [r.seq for r in R.page_after(df, T0 + timedelta(minutes=4), 4, 2).collect()] == [3, 2]
    # Of one second the higher seq comes first, though it is the earlier moment.
    close = frame(reading(1), reading(2)).withColumn(
        "ts", F.col("ts") + F.when(F.col("seq") == 1, F.expr("interval 200 milliseconds")).otherwise(
            F.expr("interval 100 milliseconds")))
    first = R.newest_first(close, 1).first()
    assert first.seq == 2
    assert [r.seq for r in R.page_after(close, first.ts, first.seq, 5).collect()] == [1]


def fleet(frame):
    df = frame(
        reading(2, 1, temp=90.0), reading(1, 0, uuid="first", temp=20.0),
        reading(3, 2, gpu="1", util=-1.0), reading(4, 0, host="h2"), reading(5, 0, host="h3", cluster="c2"))
    return df, G.register_hosts(df), G.register_gpus(df)


def test_registry(frame):
    df, hosts, gpus = fleet(frame)
    host = {r.hostname: r for r in hosts.collect()}["h1"]
    assert (host.created_at, host.status.last_seen) == (T0, T0 + timedelta(minutes=2))
    assert host.status.health_checks == {"ping": "ok"} and host.ip_address == "unknown"
    gpu = {(r.hostname, r.gpu_id): r for r in gpus.collect()}["h1", "0"]
    assert (gpu.uuid, gpu.device_name, gpu.memory_total_mb) == ("first", "V100", 0)


def test_status_and_roll_ups(frame):
    df, hosts, gpus = fleet(frame)
    idle = frame(reading(9, host="h9", cluster="c9"))
    gpus = gpus.unionByName(G.register_gpus(idle))
    status = G.gpu_status(gpus, df)
    state = {(r.hostname, r.gpu_id): r.status for r in status.collect()}
    assert (state["h1", "0"].temperature_celsius, state["h1", "0"].healthy) == (90.0, False)
    assert state["h1", "1"].healthy is False and state["h2", "0"].healthy
    assert state["h9", "0"].healthy and state["h9", "0"].utilization_percent == 0.0
    meta = {r.cluster_id: r for r in A.cluster_metadata(hosts, status).collect()}
    assert tuple(meta["c1"])[1:] == (2, 3, 2, 1) and tuple(meta["c9"])[1:] == (0, 1, 0, 1)
    counts = {r.hostname: r.gpu_count for r in A.hosts_with_gpu_count(
        hosts, status.filter("hostname <> 'h3'")).collect()}
    assert counts == {"h1": 2, "h2": 1, "h3": 0}
    assert A.cluster_counts(hosts, gpus, "c").count() == 0  # "c" is no prefix match of "c1"
    listed = {r.id: r for r in G.list_clusters(
        hosts, A.cluster_counts(hosts, status)).collect()}
    assert (listed["c1"].host_count, listed["c1"].gpu_count) == (2, 3)
    stats = {r.cluster_id: r for r in A.cluster_stats(df, hosts, status).collect()}["c1"]
    assert (stats.telemetry_records, stats.active_gpus) == (4, 1)
    tree = {(r.cluster.cluster_id, r.host.hostname): r for r in G.fleet_tree(
        hosts, status, A.cluster_metadata(hosts, status)).collect()}
    assert [g.gpu_id for g in tree["c1", "h1"].gpus] == ["0", "1"]
    assert tree["c1", "h1"].cluster.total_gpus == 3


def test_fleet_tree_in_parts(frame):
    df = frame(*[reading(i, gpu=str(i)) for i in range(40)])
    hosts, status = G.register_hosts(df), G.gpu_status(G.register_gpus(df), df)
    tree = G.fleet_tree(hosts, status, A.cluster_metadata(hosts, status), parts=4).collect()
    assert {r.part for r in tree} == set(range(4))
    assert sorted(int(g.gpu_id) for r in tree for g in r.gpus) == list(range(40))


def test_list_gpus_last_key_wins(frame):
    df = frame(reading(1, host="h1", uuid="u"), reading(2, host="h2", uuid="u"),
               reading(3, host="h3", uuid=""), reading(4, host="h3", gpu="1", uuid=""))
    listed = G.list_gpus(G.register_gpus(df)).collect()
    assert sorted((r.hostname, r.id) for r in listed) == [("h2", "0"), ("h3", "0"), ("h3", "1")]


def test_reconcile(spark):
    source = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)], "k string")
    sink = spark.createDataFrame([("a",)] * 2 + [("b",)] * 2 + [("d",)], "k string")
    got = {r.k: (r.percent, r.status) for r in A.reconcile_counts(source, sink, ["k"]).collect()}
    assert got == {"a": (66.66, "partial"), "b": (100.0, "complete"), "c": (0.0, "none"),
                   "d": (0.0, "partial")}


def test_first_n_per_hot_key(spark):
    df = spark.range(0, 5000, 1, 40).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = first_n_per_key(df, ["k"], [F.col("id")], 7, lanes=16)
    assert [r.id for r in got.filter("k = 'hot'").orderBy("id").collect()] == [3 * i for i in range(7)]
    assert got.count() == 7 + 5000 - 1667


def message_log(spark):
    rows = [(i, f"m{i}", "t" if i % 4 else "u", i * 10) for i in range(20)]
    return spark.createDataFrame(rows, "seq long, message_id string, topic string, ttl int").selectExpr(
        "message_id", "topic", "concat('/telemetry/queue/', topic, '/', lpad(seq, 5, '0')) as stream_key",
        "timestamp'2024-01-01 00:00:00Z' as created_at",
        "timestamp'2024-01-01 00:00:00Z' + make_dt_interval(0, 0, 0, ttl) as expires_at", "seq")


def test_queue(spark):
    log = message_log(spark)
    at = "2024-01-01T00:00:30Z"
    assert queue.live_messages(log, at).count() == 17  # exactly at the deadline is still alive
    assert queue.expired_messages(log, at).count() == 3
    # The oldest three of topic t are 1, 2 and 3; the limit counts expired ones.
    assert [r.seq for r in queue.consume_fifo(log, "t", 3, at).collect()] == [3]
    assert {r.seq for r in queue.consume_many(log, ["t", "u"], 3, at).collect()} == {3, 4, 8}
    claimed, remaining = queue.claim_work(log, "t", ["a", "b"], 2, at)
    assert {(r.seq, r.consumer_id) for r in claimed.collect()} == {(3, "a"), (5, "b")}
    assert remaining.count() == 16
    acks = spark.createDataFrame([("m1", "t", "x"), ("m1", "t", "y"), ("gone", "t", "x")],
                                 "message_id string, topic string, consumer_id string")
    assert queue.ack_messages(log, acks).count() == 19
    acked, failed = queue.ack_outcome(log, acks)
    assert [r.message_id for r in acked.collect()] == ["m1"]
    assert [r.message_id for r in failed.collect()] == ["gone"]
    stats = {r.topic: r for r in queue.topic_stats(log, acks, at).collect()}["t"]
    assert (stats.message_count, stats.consumer_count, stats.processed_count, stats.pending_count) == (
        15, 2, 1, 13)
    assert tuple(queue.queue_totals(log, acks, at).first()) == (20, 17, 1, 1)
    assert queue.topic_exists(log, "u") and not queue.topic_exists(log, "v")


def test_a_payload_is_one_object_and_its_common_form_is_parsed_once(spark):
    whole = ['{"gpu_id":"1"}', ' {"gpu_id":"1"} ', '{"gpu_id":"}"}', '{"uuid":"NVIDIA"}', '{"custom_metrics":{"a":1}}',
             "{'gpu_id':'1'}", '{"other":[1,{"b":2}]}', "{}"]
    broken = ['{"a":1}{"b":2}', '{"a":1}}', '{"a":1} x', '{"a":NaN}', '{"a":-INF}', '{"a":Infinity}', "[]", "", "{",
              '{"a":1', '{"a" 1}', '{"a":01}', '"}', '{"gpu_utilization":"}']
    df = spark.createDataFrame([(p.encode(),) for p in whole + broken], "payload binary")
    got = {r.payload.decode(): r.broken for r in messages.parse_messages(df, RECORD_WITH_CUSTOM).collect()}
    assert got == {p: False for p in whole} | {p: True for p in broken}
    common = spark.createDataFrame([(p,) for p in ('{"gpu_id":"1"}', '{"gpu_id":"1","a":0.5}')], "p string")
    assert common.filter(F.col("p").rlike(messages._PLAIN)).count() == 2


def test_recover_orphans(spark):
    log = message_log(spark)
    waiting, processing = log.filter("seq < 5"), log.filter("seq >= 5")
    same, still = queue.recover_orphans(waiting, processing, "2024-01-01T00:01:00Z", 60)
    assert (same.count(), still.count()) == (5, 15)  # not older than the limit
    back, still = queue.recover_orphans(waiting, processing, "2024-01-01T00:01:00Z", 59)
    assert (back.count(), still.count()) == (20, 0)
    assert back.filter("message_id = 'm7'").first().stream_key == (
        "/telemetry/queue/t/1704067260000000000_m7_1704067260")


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_batches_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(1)
    rows = [(i, T0 + timedelta(seconds=i), "hot" if rng.random() < 0.6 else f"h{i % 3}", "0")
            for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, hostname string, gpu_id string")
    want = {}
    for seq, _, host, _ in rows:
        want.setdefault(host, []).append(seq)
    got = batching.pack_batches(df, "hostname", 40, range_rows=chunk).collect()
    for r in got:
        expected = want[r.partition][r.batch_no * 40:(r.batch_no + 1) * 40]
        assert [x.seq for x in r.records] == expected and r.n == len(expected)
    assert sum(r.n for r in got) == 500


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_changes_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaab"), rng.choice(["PUT", "PUT", "DELETE"])) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, key string, op string")
    present, want = {}, {}
    for seq, key, op in rows:
        want[seq] = "delete" if op == "DELETE" else "update" if present.get(key) else "create"
        present[key] = op == "PUT"
    got = changes.classify_changes(df, ["key"], range_rows=chunk)
    assert {r.seq: r.event_type for r in got.collect()} == want


def test_config(spark):
    rows = [(1, "a", "PUT", "1"), (2, "a", "PUT", "2"), (3, "b", "PUT", "1"), (4, "b", "DELETE", None),
            (5, "c", "PUT", '"x"'), (6, "c", "PUT", "{broken")]
    log = spark.createDataFrame(rows, "seq long, key string, type string, value string")
    got = {r.key: r.value for r in changes.current_config(log, {"a": "0", "b": "9", "d": "true"}).collect()}
    assert got == {"a": "2", "b": "9", "c": '"x"', "d": "true"}
    assert {r.key for r in changes.current_config(log).collect()} == {"a", "c"}


def test_snapshot_diff(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, v int, m map<string,string>")
    old = make([("a", 1, {"x": "1"}), ("b", 1, None), ("c", None, {}), ("e", 1, {"x": "1", "y": "2"})])
    new = make([("a", 1, {"x": "2"}), ("c", None, {}), ("d", 4, None), ("e", 1, {"y": "2", "x": "1"})])
    got = {r.k: r.event_type for r in changes.snapshot_diff(old, new, ["k"]).collect()}
    assert got == {"a": "update", "b": "delete", "d": "create"}


METRIC_COLUMNS = "service_type string, instance_id string, cpu_usage double, memory_usage double, " \
                 "queue_depth double, health string, ts timestamp_ntz"


def decide(spark, metrics, decisions=(), **rules):
    noon = datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([("s", *m[:-1], noon - timedelta(seconds=m[-1])) for m in metrics], METRIC_COLUMNS)
    past = spark.createDataFrame(
        [("s", a, noon - timedelta(seconds=age)) for a, age in decisions],
        "service_type string, action string, ts timestamp_ntz")
    table = S.default_rules(spark.createDataFrame([("s",)], "service_type string"))
    table = table.withColumns({k: F.lit(v) for k, v in rules.items()})
    return S.scaling_decisions(df, past, table, "2024-01-01T12:00:00Z").first()


HIGH = ("i0", 0.9, 0.85, 100.0, "healthy", 10)
LOW = [(f"i{n}", 0.1, 0.15, 2.0, "unhealthy", 10) for n in range(4)]


def test_scaling(spark):
    d = decide(spark, [])
    assert (d.action, d.current_count, d.recommended_count, d.reason, d.confidence) == (
        "no_action", 0, 1, "no metrics available", 0.5)
    d = decide(spark, [HIGH[:-1] + (121,)])
    assert (d.action, d.recommended_count, d.reason) == ("no_action", 1, "no recent metrics available")
    assert decide(spark, [HIGH[:-1] + (120,)]).action == "scale_up"
    d = decide(spark, [HIGH])
    assert (d.action, d.current_count, d.recommended_count, d.confidence) == ("scale_up", 1, 2, 1.0)
    assert d.reason == "high load detected: 92.50% > 80.00%"
    assert decide(spark, [HIGH], max_instances=1).action == "no_action"
    d = decide(spark, LOW)
    assert (d.action, d.current_count, d.recommended_count) == ("scale_down", 4, 3)
    assert d.reason == "low load detected: 8.30% < 30.00%"
    d = decide(spark, [("i0", 0.5, 0.5, 50.0, "healthy", 1)])
    assert (d.action, d.reason, d.confidence) == (
        "no_action", "load within acceptable range: 50.00%", 0.9)
    d = decide(spark, [("i0", 0.0, 0.0, 0.0, "healthy", 1), ("i1", 0.0, 0.0, 0.0, "healthy", 1)])
    assert (d.action, d.confidence) == ("scale_down", 1.0)


def test_cooldown(spark):
    d = decide(spark, [HIGH], [("scale_up", 10), ("no_action", 400)])
    assert (d.action, d.recommended_count, d.reason, d.confidence) == (
        "no_action", 1, "in cooldown period", 0.8)
    assert decide(spark, [HIGH], [("scale_up", 300)]).action == "scale_up"
    assert decide(spark, [HIGH], [("no_action", 5), ("scale_up", 10)]).action == "scale_up"


def test_service_load(spark):
    rows = [("s", "a", 0.8, 0.7, 80.0, "healthy", T0), ("s", "b", 0.4, 0.5, 20.0, "degraded", T0),
            ("s", "b", 0.0, 0.0, 0.0, "healthy", T0 - timedelta(seconds=30)),
            ("old", "a", 0.8, 0.7, 80.0, "healthy", T0 - timedelta(hours=1))]
    df = spark.createDataFrame(rows, METRIC_COLUMNS)
    got = {r.service_type: r for r in S.service_load(df, T0).collect()}
    assert got["s"].load == pytest.approx(0.56) and got["s"].healthy_count == 1
    assert (got["old"].load, got["old"].instance_count) == (0.0, 0)


def test_live_services(spark):
    rows = [("x", "a", T0, "healthy"), ("x", "a", T0 + timedelta(seconds=20), ""),
            ("x", "b", T0, "healthy"), ("y", "c", T0 + timedelta(seconds=25), "unhealthy")]
    df = spark.createDataFrame(rows, "service_type string, instance_id string, ts timestamp_ntz, health string")
    at = T0 + timedelta(seconds=30)
    assert {(r.instance_id, r.health) for r in live_services(df, at).collect()} == {
        ("a", "healthy"), ("c", "unhealthy")}
    assert [r.instance_id for r in live_services(df, at, service_type="y").collect()] == ["c"]


@pytest.mark.parametrize("size", [7, 100, 5000])
def test_throttle_equals_a_plain_loop(spark, size):
    rng = random.Random(3)
    rows, clock = [], {"hot": 0, "cold": 0}
    for i in range(600):
        key = "hot" if rng.random() < 0.8 else "cold"
        clock[key] += rng.choice([0, 1000, 40_000, 400_000, 2_500_000])
        rows.append((i, key, T0 + timedelta(microseconds=clock[key])))
    df = spark.createDataFrame(rows, "seq long, k string, ts timestamp_ntz")
    buckets, want = {}, {}
    for seq, key, ts in rows:
        bucket = buckets.setdefault(key, Bucket(4.0, 5))
        want[seq] = bucket.take(round((ts - T0).total_seconds() * 1e6))
    got = throttle_flags(df, "k", 4.0, 5, range_rows=size)
    assert {r.seq: r.allowed for r in got.collect()} == want
    assert 0 < sum(want.values()) < 600


def test_throttle_keeps_numeric_keys_and_times_apart(spark):
    """NULL is one key, numbers above 2**53 are different ones, and other columns pass through unchanged."""
    big = 2**53
    rows = [(i, None, T0, big + i) for i in range(6)] + [(10 + i, big + i, T0, None) for i in range(3)]
    rows += [(20, 5, None, 1), (None, 5, None, 2), (21, 5, T0, 3)]
    df = spark.createDataFrame(rows, "seq long, k long, ts timestamp_ntz, other long")
    got = {(r.seq, r.k): (r.allowed, r.other) for r in throttle_flags(df, "k", 0.001, 2).collect()}
    assert [got[i, None] for i in range(6)] == [(i < 2, big + i) for i in range(6)]
    assert [got[10 + i, big + i] for i in range(3)] == [(True, None)] * 3
    assert got[None, 5] == (True, 2) and got[20, 5] == (True, 1) and got[21, 5] == (True, 3)
    nan = spark.createDataFrame([(i, float("nan"), T0) for i in range(4)], "seq long, k double, ts timestamp")
    assert sorted(r.allowed for r in throttle_flags(nan, "k", 0.001, 2).collect()) == [False, False, True, True]


@pytest.mark.parametrize("size", [150, 10**6])
def test_a_hot_key_without_rests_is_cut(spark, size):
    """Gaps never last as long as the bucket takes to fill, yet most segments are short."""
    from fleetmetrics.operators import throttle
    from fleetmetrics.operators.batching import by_ranges

    rng = random.Random(8)
    clock, rows, bucket, want = 0, [], Bucket(2.0, 20), {}
    for i in range(3000):
        clock += rng.choice([100_000, 300_000, 500_000, 900_000, 1_500_000])
        rows.append((i, "k", clock))
        want[i] = bucket.take(clock)
    rows += [(3000 + i, "k", clock) for i in range(30)]
    want |= {3000 + i: bucket.take(clock) for i in range(30)}
    df = spark.createDataFrame(rows, "seq long, k string, us long").selectExpr("seq", "k", "timestamp_micros(us) as ts")
    got = {r.seq: r.allowed for r in throttle_flags(df, "k", 2.0, 20, range_rows=size).collect()}
    assert got == want and 0 < sum(want.values()) < 3030
    timed = by_ranges(df.selectExpr("*", "unix_micros(ts) as _micros", "seq as _seq"), ["k"], ["_micros", "_seq"], size)
    sizes = [r["count"] for r in throttle._segments(timed, "k", 2.0).groupBy("_segment").count().collect()]
    assert len(sizes) > 300 and max(sizes) < 200


def test_runs_are_even_however_values_are_spread(spark):
    from fleetmetrics.operators.batching import by_ranges

    df = spark.range(20_000).selectExpr("if(id < 18000, 'hot', string(id % 50)) as k", "id * id * id as seq")
    sizes = [r["count"] for r in by_ranges(df, ["k"], ["seq"], 1000).groupBy("_range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000
    placed = batching.running_position(df, ["k"], "seq", into="p", range_rows=1000)
    want = df.selectExpr("k", "seq", "row_number() over (partition by k order by seq) - 1 as p")
    assert placed.select("k", "seq", "p").exceptAll(want).count() == 0 and placed.count() == 20_000


def test_sender_metrics(spark):
    df = spark.createDataFrame([(5, True, T0), (3, True, T0), (9, False, T0)],
                               "n long, ok boolean, sent_at timestamp_ntz")
    out = A.sender_metrics(df, T0, T0 + timedelta(seconds=4)).first()
    assert tuple(out) == (8, 2, 1, T0, 2.0)


def test_null_keys_survive(spark):
    rows = spark.createDataFrame(
        [(1, None, "PUT"), (2, "k", "PUT"), (3, None, "PUT"), (None, "k", "DELETE"), (4, None, "DELETE")],
        "seq long, key string, op string")
    found = {(r.seq, r.key): r.event_type for r in changes.classify_changes(rows, ["key"]).collect()}
    assert found == {(1, None): "create", (2, "k"): "create", (3, None): "update", (None, "k"): "delete",
                     (4, None): "delete"}
    packed = batching.pack_batches(rows.withColumnRenamed("key", "hostname").withColumn("ts", F.current_timestamp()), "hostname", 2)
    assert sorted((r.partition or "", r.batch_no, r.n) for r in packed.collect()) == [("", 0, 2), ("", 1, 1), ("k", 0, 2)]
    timed = rows.select("seq", "key", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, seq)").alias("ts"))
    flagged = throttle_flags(timed.where("seq is not null"), "key", 0.1, 1)
    assert {r.seq: r.allowed for r in flagged.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_kv_dump_is_parsed_in_one_pass(spark):
    from fleetmetrics.sources import store

    base = "/telemetry/clusters/c1"
    dump = spark.createDataFrame([
        (base, '{"cluster_id": "c1", "region": "eu"}'), (f"{base}/hosts/h1", '{"hostname": "h1", "os_version": "x"}'),
        (f"{base}/hosts/h1/gpus/0", '{"uuid": "U"}'), (f"{base}/hosts/h1/gpus/0/data/p1", '{"uuid": "U", "temperature": 5}'),
        (f"{base}/hosts/h1/gpus/0/data/p2", '{"uuid": '), (f"{base}/hosts/h2", None), ("/elsewhere/x", "{"),
    ], "key string, value string")
    parsed = store.parse_kv_dump(dump)
    clusters, hosts, gpus, points = store.kv_documents(parsed)
    assert [(r.cluster_id, r.region) for r in clusters.collect()] == [("c1", "eu")]
    assert [(r.cluster_id, r.hostname, r.os_version) for r in hosts.collect()] == [("c1", "h1", "x")]
    assert [(r.hostname, r.gpu_id, r.uuid) for r in gpus.collect()] == [("h1", "0", "U")]
    assert [(r.telemetry_id, r.temperature) for r in points.collect()] == [("p1", 5.0)]
    broken = store.broken_documents(parsed)
    assert sorted((r.key.rsplit("/", 1)[1], r.kind) for r in broken.collect()) == [("h2", "host"), ("p2", "data")]
    plan = broken._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_runs_are_small_enough_to_sort(spark):
    """The task that writes a run sorts it, so that runs of the usual size stay far below the memory of a task."""
    rows = spark.range(1_500_000).select(F.lit("k").alias("k"), F.col("id").alias("seq"))
    sizes = [r["count"] for r in batching.by_ranges(rows, ["k"], ["seq"]).groupBy("_range").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 1_000_000 and sum(sizes) == 1_500_000


@pytest.mark.parametrize("size", [1, 40, 5000])
def test_many_first_rows_are_not_picked_by_one_task(spark, monkeypatch, size):
    """Ties by the second, rows without a time or number, and runs of rows that agree in both."""
    monkeypatch.setattr(R, "FIRST_ROWS", size)
    rng = random.Random(8)
    data = [
        (rng.choice([None, *range(900)] if rng.random() < 0.1 else range(900)),
         None if rng.random() < 0.05 else T0 + timedelta(milliseconds=rng.choice([100, 100, 400 * i])))
        for i in range(3000)
    ]
    df = spark.createDataFrame(data, "seq long, ts timestamp").repartition(5)
    second = lambda t: (t is not None, t and t.replace(microsecond=0))
    number = lambda s: (s is not None, s)
    newest = sorted(data, key=lambda r: (second(r[1]), number(r[0])), reverse=True)
    oldest = sorted(data, key=lambda r: ((r[1] is not None, r[1]), number(r[0])))
    for limit in (41, 700, 2999, 3000, 9000):
        got = [(r.ts and r.ts.replace(microsecond=0), r.seq) for r in R.newest_first(df, limit).collect()]
        assert got == [(t and t.replace(microsecond=0), s) for s, t in newest[:limit]]
        assert [(r.seq, r.ts) for r in R.oldest_first(df, limit).collect()] == oldest[:limit]


def test_parted_first_rows_leave_few_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(R, "FIRST_ROWS", 1000)
    df = spark.range(0, 200_000, 1, 8).selectExpr("id as seq", "timestamp_seconds(id % 5000) as ts")
    plan = R.newest_first(df, 20_000)._jdf.queryExecution().optimizedPlan().toString()
    limits = [int(n) for n in re.findall(r"GlobalLimit (\d+)", plan)]
    assert limits and max(limits) <= 1000
    assert R.newest_first(df, 20_000).selectExpr("min(ts)", "count(1)", "count(distinct seq)").first()[1:] == (20_000, 20_000)
