import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetmetrics.operators import queue, readings as R
from fleetmetrics.operators import registry as G
from fleetmetrics.operators.batching import pack_batches
from fleetmetrics.operators.changes import classify_changes
from fleetmetrics.operators.rollups import add_tallies, reading_tallies
from fleetmetrics.operators.throttle import throttle_flags
from fleetmetrics.plans.collect import collect_messages
from fleetmetrics.session import shared_dir
from fleetmetrics.sources.messages import decode_messages, encode_messages
from fleetmetrics.sources.store import read_readings, write_readings
from fleetmetrics.streaming import jobs, point_store, sinks, stateful, windows
from test_operators import T0, WIDE, reading

NOW = "2024-02-01T12:00:00Z"
HEADER = ["timestamp", "GPU_ID", "hostname", "temperature"]


def stream(spark, *frames):
    """Each frame as a file of its own, one per micro-batch."""
    path = shared_dir(spark, "input")
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return jobs.snapshot_then_tail(spark, path, frames[0].schema, files_per_trigger=1)


def table(spark, sdf, mode="append"):
    path = shared_dir(spark, "output")
    sinks.start_table(sdf, f"{path}/out", f"{path}/ckpt", mode).awaitTermination()
    return sinks.read_batches_of(spark, f"{path}/out")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ingest_stream_picks_up_new_files_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def put(name, *lines):
        (folder / name).write_text("\n".join([",".join(HEADER), *lines]) + "\n")

    totals = sinks.SenderTotals()

    def run():
        jobs.run_ingest_stream(
            spark, str(folder), out, f"{out}/ckpt", as_of=NOW, totals=totals
        ).awaitTermination()
        sent = sinks.read_batches_of(spark, f"{out}/messages")
        return sorted(r.gpu_id for r in decode_messages(sent)[0].collect())

    put("a.csv", "2024-01-01T00:00:00Z,0,h,1", "2024-01-01T00:00:00Z,,h,1")
    assert run() == ["0"]
    put("b.CSV", "2024-01-01T00:00:00Z,1,h,1")
    (folder / "c.txt").write_text("x\n")
    assert run() == ["0", "1"] and run() == ["0", "1"]
    assert (totals.records, totals.batches, totals.errors) == (2, 2, 0) and totals.processing_rate > 0
    assert sinks.read_batches_of(spark, f"{out}/rejects").count() == 1


def test_ingest_stream_binds_each_file_by_its_own_header(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text("timestamp,gpu_id,hostname,temperature,power_draw\n2024-01-01T00:00:00Z,0,h,1,2\n")
    (folder / "b.csv").write_text("power_draw,temperature,Hostname,GPU_ID,timestamp\n4,3,h,1,2024-01-01T00:00:00Z\n")
    (folder / "c.csv").write_text("timestamp,gpu_id\n2024-01-01T00:00:00Z,2\n")
    jobs.run_ingest_stream(spark, str(folder), out, f"{out}/ckpt", as_of=NOW).awaitTermination()
    sent = decode_messages(sinks.read_batches_of(spark, f"{out}/messages"))[0]
    assert rows(sent.select("gpu_id", "hostname", "temperature", "power_draw")) == [("0", "h", 1.0, 2.0), ("1", "h", 3.0, 4.0)]


def test_write_batch_can_be_replayed(spark, tmp_path):
    path, name = str(tmp_path / "t"), sinks.BatchName("s", 3)
    folder = tmp_path / "t" / name.folder
    sinks.write_batch(spark.range(5), path, name)
    before = set(folder.iterdir())
    assert sinks.read_batches_of(spark, path).count() == 5
    # A finished batch stays as it is, also where Spark leaves no markers of its own.
    (folder / "_SUCCESS").unlink()
    before -= {folder / "_SUCCESS", folder / "._SUCCESS.crc"}
    sinks.write_batch(spark.range(7), path, name)
    assert set(folder.iterdir()) - {folder / "._SUCCESS.crc"} == before
    # What an interrupted one left is replaced.
    spark.range(9).write.parquet(f"{path}/from_stream=s/micro_batch=4")
    sinks.write_batch(spark.range(2), path, sinks.BatchName("s", 4))
    sinks.write_batch(spark.range(3), path, sinks.BatchName("other", 3))
    assert sinks.read_batches_of(spark, path).count() == 5 + 2 + 3
    assert rows(sinks.finished_batches(spark, path)) == [("other", 3), ("s", 3), ("s", 4)]
    assert sinks.finished_batches(spark, str(tmp_path / "none")).count() == 0


def test_two_streams_into_one_folder(spark, tmp_path):
    out = str(tmp_path / "out")
    for part in "abab":
        folder = tmp_path / part
        folder.mkdir(exist_ok=True)
        (folder / "f.csv").write_text(f"{','.join(HEADER)}\n2024-01-01T00:00:00Z,{part},h,1\n")
        jobs.run_ingest_stream(spark, str(folder), out, f"{out}/ckpt-{part}", as_of=NOW).awaitTermination()
    sent = sinks.read_batches_of(spark, f"{out}/messages")
    assert sorted(r.gpu_id for r in decode_messages(sent)[0].collect()) == ["a", "b"]
    packed = str(tmp_path / "packed")
    for part in (1, 2):
        one = spark.createDataFrame([reading(part, part)], WIDE)
        jobs.batch_stream(stream(spark, one), "hostname", 5, f"{packed}/out", f"{packed}/ckpt-{part}", None).awaitTermination()
    assert sinks.read_batches_of(spark, f"{packed}/out").selectExpr("sum(n)").first()[0] == 2


def test_versions_of_the_store(spark):
    """Clusters named like numbers, two writers, days that only one version touches."""
    out = shared_dir(spark, "store")

    def collect(part, clusters, *data):
        df = spark.createDataFrame(list(data), WIDE)
        for cluster in clusters:
            sdf = stream(spark, encode_messages(df, "telemetry", 60, NOW))
            where = f"{out}/ckpt-{part}-{cluster}"
            jobs.run_collect_stream(sdf, out, where, as_of=NOW, cluster_id=cluster).awaitTermination()

    def seen(**version):
        got = point_store.current_points(spark, out, **version)
        return rows(got.select("cluster_id", F.col("event_date").cast("string"), "gpu_id", "temperature"))

    broken = encode_messages(spark.createDataFrame([reading(1)], WIDE), "telemetry", 60, NOW)
    broken = broken.withColumn("payload", F.encode(F.lit("{"), "UTF-8"))
    jobs.run_collect_stream(stream(spark, broken), out, f"{out}/ckpt", as_of=NOW).awaitTermination()
    assert seen() == []
    day = 24 * 3600
    collect(1, ("007", "7"), reading(1, 0, temp=1.0), reading(2, day, temp=2.0))
    first = seen()
    assert len(first) == 4 and {r[0] for r in first} == {"007", "7"}
    point_store.compact_points(spark, out, 1)
    assert seen(version=1) == first
    collect(2, ("7",), reading(3, day, temp=3.0), reading(4, 2 * day, gpu="1", temp=4.0))
    second = seen()
    assert second != first and seen(version=1) == second
    point_store.compact_points(spark, out, 2, previous=1)
    assert seen(version=2) == second
    # The second version holds only the days that were touched, and finds the others where they were.
    written = sinks.read_named_batches(spark, f"{out}/days").groupBy("written_in", "cluster_id").count()
    assert rows(written) == [(1, "007", 2), (1, "7", 2), (2, "7", 2)]
    collect(3, ("8",), reading(5, 0))
    whole = point_store.current_points(spark, out, version=2)
    tallies = point_store.current_tallies(spark, out, version=2)
    assert rows(add_tallies(tallies)) == rows(reading_tallies(whole)) and tallies.count() == 6
    one_day = R.time_range(point_store.current_points(spark, out, version=2), T0, T0 + timedelta(hours=1))
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and ("/points]" in line or "/days]" in line)]
    assert len(scans) >= 3 and all("event_date" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)
    assert "dynamicpruning" in plan.lower()
    assert sorted(r.cluster_id for r in one_day.collect()) == ["007", "7", "8"]


def test_collect_stream_equals_the_batch_job(spark):
    first = spark.createDataFrame(
        [reading(i, i % 7, gpu=str(i % 3), temp=float(80 + i)) for i in range(20)], WIDE)
    later = spark.createDataFrame([reading(30, 3, temp=1.0), reading(31, 9, gpu="1", temp=99.0),
                                   reading(32, 0, gpu="new")], WIDE)
    sent = [encode_messages(df, "telemetry", 60, at) for df, at in
            ((first, "2024-02-01T00:00:00Z"), (later, "2024-02-01T00:01:00Z"))]
    broken = sent[0].limit(1).withColumn("payload", F.encode(F.lit("{"), "UTF-8"))
    sdf = stream(spark, sent[0].unionByName(broken), sent[1])
    out = shared_dir(spark, "store")
    jobs.run_collect_stream(sdf, out, f"{out}/ckpt", as_of=NOW).awaitTermination()
    batch = collect_messages(sent[0].unionByName(sent[1]), NOW)
    pick = ("telemetry_id", "stream_key", "temperature", "batch_id", "collector_id")
    points = point_store.current_points(spark, out)
    assert rows(points.select(*pick)) == rows(batch.points.select(*pick))
    status = ("hostname", "gpu_id", "uuid", "status")
    assert rows(jobs.current_gpus(spark, out).select(*status)) == rows(batch.gpus.select(*status))
    assert rows(jobs.current_hosts(spark, out).select("hostname", "created_at", "status.last_seen")) == \
        rows(batch.hosts.select("hostname", "created_at", "status.last_seen"))
    assert sinks.read_batches_of(spark, f"{out}/dead_letters").count() == 1
    point_store.compact_points(spark, out, 0)
    assert rows(point_store.current_points(spark, out, version=0).select(*pick)) == rows(points.select(*pick))
    point_store.compact_points(spark, out, 1, previous=0)
    assert rows(point_store.current_points(spark, out, version=1).select(*pick)) == rows(points.select(*pick))


def test_compaction_deals_the_rows_out_once(spark, monkeypatch):
    """A big day goes to several tasks, each GPU's to one; the last write counts, and an unnamed cluster's rows stay."""
    named = lambda df, c: df.withColumn("cluster_id", F.lit(c))
    data = spark.createDataFrame([reading(i, i % 40, gpu=str(i % 7), temp=float(i)) for i in range(200)], WIDE)
    points = named(data, "a").unionByName(named(data.limit(20), None)).select(
        "*", F.to_date("ts").alias("event_date"), F.lpad(F.col("seq").cast("string"), 6, "0").alias("stream_key"),
        F.lit("").alias("telemetry_id"),
    )
    monkeypatch.setattr(point_store, "PART_ROWS", 50)
    merged = point_store._merged_for_files(points)
    pick = ("hostname", "gpu_id", "telemetry_id", "stream_key", "temperature")
    for c in (F.col("cluster_id") == "a", F.col("cluster_id").isNull()):
        assert rows(merged.filter(c).select(*pick)) == rows(point_store._merged(points).filter(c).select(*pick))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "_part" in plan  # one of them counts the days


def test_collect_reads_malformed_messages_whole(spark):
    sent = encode_messages(spark.createDataFrame([reading(i, i) for i in range(4)], WIDE), "telemetry", 60, NOW)
    broken = sent.limit(2).withColumn("payload", F.encode(F.lit('{"a":NaN}'), "UTF-8"))
    out, totals = shared_dir(spark, "store"), sinks.SenderTotals()
    sdf = stream(spark, sent.unionByName(broken), sent)
    jobs.run_collect_stream(sdf, out, f"{out}/ckpt", as_of=NOW, totals=totals).awaitTermination()
    letters = sinks.read_batches_of(spark, f"{out}/dead_letters")
    assert rows(letters.select("message_id", "bad_payload", "expires_at", F.col("headers")["hostname"])) == \
        rows(broken.select("message_id", F.lit('{"a":NaN}'), "expires_at", F.col("headers")["hostname"]))
    assert totals.records == 8


def test_first_sightings_and_status(spark):
    a = spark.createDataFrame([reading(1, 0), reading(2, 1, gpu="1"), reading(3, 2)], WIDE)
    b = spark.createDataFrame([reading(4, 1, temp=3.0), reading(5, 9, gpu="1", temp=5.0)], WIDE)
    sdf = stream(spark, a, b)
    keys = ["cluster_id", "hostname", "gpu_id"]
    unique = table(spark, windows.dedup_stream(sdf, keys))
    assert sorted(r.gpu_id for r in unique.collect()) == ["0", "1"]
    updates = table(spark, windows.latest_status_stream(sdf), "update")
    final = R.latest_readings(updates).select("gpu_id", "seq")
    assert rows(final) == rows(R.latest_readings(a.unionByName(b)).select("gpu_id", "seq")) == [("0", 3), ("1", 5)]


def test_status_is_read_from_the_state(spark):
    a = spark.createDataFrame([reading(1, 0, temp=90.0), reading(2, 1, gpu="1"), reading(3, 2, temp=20.0)], WIDE)
    b = spark.createDataFrame([reading(4, 1, temp=3.0), reading(5, 9, gpu="1", temp=95.0), reading(6, 2, temp=21.0)], WIDE)
    path = shared_dir(spark, "state")
    stateful.keep_status(stream(spark, a, b), path).awaitTermination()
    kept = stateful.kept_status(spark, path)
    assert sorted((r.gpu_id, r.seq, r.temperature) for r in kept.collect()) == [("0", 6, 21.0), ("1", 5, 95.0)]
    gpus = G.register_gpus(a)
    assert rows(G.gpu_status(gpus, kept).select("gpu_id", "status.healthy", "status.temperature_celsius")) == rows(
        G.gpu_status(gpus, a.unionByName(b)).select("gpu_id", "status.healthy", "status.temperature_celsius"))


def test_dedup_within_watermark(spark):
    df = spark.createDataFrame([reading(i, 0) for i in range(4)], WIDE)
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    assert table(spark, windows.dedup_stream(stream(spark, df, df), ["gpu_id"], "1 hour")).count() == 1


def lifetimes(spark):
    rng = random.Random(4)
    sent, acks = [], []
    for i in range(60):
        at = T0 + timedelta(minutes=i)
        sent.append((f"m{i}", "t", at, at + timedelta(minutes=rng.randint(1, 20))))
        if rng.random() < 0.6:
            acks.append((f"m{i}", at + timedelta(minutes=rng.randint(0, 25))))
    acks += [("gone", T0), ("m3", T0 + timedelta(hours=1)), ("m3", T0 + timedelta(hours=2))]
    log = spark.createDataFrame(
        sent, "message_id string, topic string, created_at timestamp, expires_at timestamp")
    return log, spark.createDataFrame(acks, "message_id string, acked_at timestamp")


def test_expiry_stream_equals_batch(spark):
    log, acks = lifetimes(spark)
    # A last message and acknowledgement far ahead let the watermark pass everything else.
    far = T0 + timedelta(days=1)
    end = spark.createDataFrame([("end", "t", far, far + timedelta(days=9))], log.schema)
    late = spark.createDataFrame([("end2", far)], acks.schema)
    sent, acked = stream(spark, log, end), stream(spark, acks, late)
    made = stateful.expire_stream(sent, acked, "1 hour")
    want = queue.expired_unacked(log, acks, far).select("message_id", "topic", "expires_at")
    got = table(spark, made).select("message_id", "topic", "expired_at")
    assert rows(got) == rows(want) and 0 < got.count() < 60


def test_expiry_in_few_buckets_equals_batch(spark):
    """Several messages to a bucket, one of them without an id."""
    log, acks = lifetimes(spark)
    log = log.unionByName(spark.createDataFrame([(None, "t", T0, T0 + timedelta(hours=3))], log.schema))
    far = T0 + timedelta(days=1)
    end = spark.createDataFrame([("end", "t", far, far + timedelta(days=9))], log.schema)
    late = spark.createDataFrame([("end2", far)], acks.schema)
    made = stateful.expire_stream(stream(spark, log, end), stream(spark, acks, late), "1 hour", buckets=3)
    want = queue.expired_unacked(log, acks, far).select("message_id", "topic", "expires_at")
    found = lambda df: sorted((str(r[0]), *r[1:]) for r in df.collect())
    assert found(table(spark, made).select("message_id", "topic", "expired_at")) == found(want)
    assert len(found(want)) > 20


class _Calls:
    """The state store of one bucket, which counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def _did(self, value=None):
        self.calls += 1
        return value

    def exists(self):
        return self._did(self.value is not None)

    def get(self):
        return self._did(self.value)

    def update(self, value):
        self._did()
        self.value = value

    def clear(self):
        self.update(None)

    def registerTimer(self, at):
        self._did(self.timers.add(at))

    def deleteTimer(self, at):
        self._did(self.timers.remove(at))

    def getCurrentWatermarkInMs(self):
        return 600


def test_expiry_asks_the_state_store_per_bucket():
    """A thousand messages, of which some are acknowledged and half are due, cost a handful of calls."""
    store, expiry = _Calls(), stateful._Expiry()
    expiry.init(store)
    message = lambda i, topic, expires, acked: Row(message_id=f"m{i}", topic=topic, expires=expires, acked=acked)
    sent = [message(i, "t", i * 1000, None) for i in range(1000)]
    acks = [message(i, None, None, i * 1000 + i % 2) for i in range(0, 1000, 5)]
    assert list(expiry.handleInputRows((0,), iter(sent + acks), store)) == []
    assert store.timers == {2}
    store.timers.clear()  # it fires
    due = [r.message_id for r in expiry.handleExpiredTimer((0,), store, None)]
    assert due == [f"m{i}" for i in range(600) if i % 10]
    assert store.timers == {602} and store.calls <= 8


def test_liveness_stretches(spark):
    beats = [("x", "a", T0 + timedelta(seconds=s), h) for s, h in
             [(0, "healthy"), (20, "unhealthy"), (60, ""), (1000, "healthy")]]
    schema = "service_type string, instance_id string, ts timestamp, health string"
    df = spark.createDataFrame(beats, schema)
    got = table(spark, windows.liveness_stream(stream(spark, df), 30))
    at = lambda s: T0 + timedelta(seconds=s)
    assert rows(got) == [("x", "a", at(0), at(50), "unhealthy", 2), ("x", "a", at(60), at(90), "healthy", 1)]


def test_throttle_stream_equals_batch(spark):
    rng = random.Random(5)
    clock, data = 0, []
    for i in range(300):
        clock += rng.choice([0, 50, 400, 3000])
        data.append((i, "k", T0 + timedelta(milliseconds=clock)))
    schema = "seq long, k string, ts timestamp"
    df = spark.createDataFrame(data, schema)
    parts = [spark.createDataFrame(data[a:b], schema) for a, b in ((0, 100), (100, 300))]
    got = table(spark, stateful.throttle_stream(stream(spark, *parts), "k", 2.0, 3))
    assert rows(got.select("seq", "allowed")) == rows(throttle_flags(df, "k", 2.0, 3).select("seq", "allowed"))


def shuffled_by_time(spark, data, schema, far):
    """Rows as batches in which each may come one batch late, and a last row that lets the watermark pass them."""
    rng = random.Random(12)
    size, batches = 60, [[] for _ in range(len(data) // 60 + 2)]
    for i, row in enumerate(data):
        batches[i // size + (rng.random() < 0.4)].append(row)
    for batch in batches:
        rng.shuffle(batch)
    batches.append([far])
    return stream(spark, *[spark.createDataFrame(b, schema) for b in batches if b])


def test_late_rows_are_throttled_in_order(spark):
    rng = random.Random(7)
    clock, data = 0, []
    for i in range(240):
        clock += rng.choice([0, 50, 400, 3000])
        data.append((i, rng.choice("kkl"), T0 + timedelta(milliseconds=clock)))
    schema = "seq long, k string, ts timestamp"
    sdf = shuffled_by_time(spark, data, schema, (999, "k", T0 + timedelta(days=1)))
    got = table(spark, stateful.throttle_stream(sdf, "k", 2.0, 3, delay="1 hour"))
    want = throttle_flags(spark.createDataFrame(data, schema), "k", 2.0, 3)
    assert rows(got.select("seq", "allowed")) == rows(want.select("seq", "allowed"))


def test_late_changes_are_told_in_order(spark):
    rng = random.Random(8)
    data = [(i, rng.choice("abc"), rng.choice(["PUT", "DELETE", "PUT"]), str(i), T0 + timedelta(seconds=i // 3)) for i in range(150)]
    schema = "seq long, key string, op string, value string, ts timestamp"
    sdf = shuffled_by_time(spark, data, schema, (999, "a", "PUT", "", T0 + timedelta(days=1)))
    got = table(spark, stateful.change_events(sdf, delay="10 minutes"))
    want = classify_changes(spark.createDataFrame(data, schema), ["key"])
    assert rows(got.select("seq", "key", "event_type")) == rows(want.select("seq", "key", "event_type"))


def test_missing_numbers_and_times_in_streams(spark):
    """NULL sorts before any value in one batch, as it does in the batch forms."""
    log = spark.createDataFrame([(2, "k", "PUT", "b"), (None, "k", "PUT", "a"), (1, "k", "DELETE", "c")],
                                "seq long, key string, op string, value string")
    got = table(spark, stateful.change_events(stream(spark, log)))
    assert {(r.seq, r.event_type) for r in got.collect()} == {(None, "create"), (1, "delete"), (2, "create")}
    timed = spark.createDataFrame([(1, "k", T0), (None, "k", T0), (3, "k", None)], "seq long, k string, ts timestamp")
    got = table(spark, stateful.throttle_stream(stream(spark, timed), "k", 0.001, 1))
    assert {(r.seq, r.allowed) for r in got.collect()} == {(3, True), (None, True), (1, False)}


def test_change_feed_across_micro_batches(spark):
    rng = random.Random(6)
    data = [(i, rng.choice("abc"), rng.choice(["PUT", "DELETE", "PUT"]), str(i)) for i in range(90)]
    schema = "seq long, key string, op string, value string"
    parts = [spark.createDataFrame(data[i:i + 30], schema) for i in (0, 30, 60)]
    seen, path = [], shared_dir(spark, "feed")

    def callback(events, batch_id):
        seen.extend((r.seq, r.key, r.event_type, r.value) for r in events.collect())

    stateful.change_feed(stream(spark, *parts), callback, f"{path}/ckpt").awaitTermination()
    want = classify_changes(spark.createDataFrame(data, schema), ["key"])
    assert sorted(seen) == rows(want.select("seq", "key", "event_type", "value"))


def test_batch_stream_flushes_every_trigger(spark):
    a = spark.createDataFrame([reading(i, i) for i in range(7)], WIDE)
    path = shared_dir(spark, "packed")
    jobs.batch_stream(stream(spark, a, a), "hostname", 5, f"{path}/out", f"{path}/ckpt", None).awaitTermination()
    got = sinks.read_batches_of(spark, f"{path}/out")
    assert sorted(r.n for r in got.collect()) == [2, 2, 5, 5]
    assert rows(sinks.read_named_batches(spark, f"{path}/out").filter("micro_batch = 0").select("batch_no", "n")) == rows(
        pack_batches(a, "hostname", 5).select("batch_no", "n"))


def test_windows_batch_equals_stream(spark):
    df = spark.createDataFrame([reading(i, i, util=float(i)) for i in range(200)], WIDE)
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    batch = windows.windowed_utilisation(df, "10 minutes", "5 minutes")
    got = table(spark, windows.windowed_utilisation(stream(spark, df), "10 minutes", "5 minutes", "0 seconds"))
    last = df.agg(F.max("ts")).first()[0]
    closed = batch.filter(F.col("window_end") <= F.lit(last))
    assert rows(got) == rows(closed) and got.count() > 30


def test_retry():
    calls, waits, totals = [], [], sinks.SenderTotals()

    def flaky(df):
        calls.append(df)
        if len(calls) < 3:
            raise OSError("down")

    assert sinks.write_with_retry("batch", flaky, delay=2.0, totals=totals, sleep=waits.append) == 3
    assert waits == [2.0, 4.0] and (totals.batches, totals.errors) == (1, 0)

    def broken(df):
        raise OSError("down")

    with pytest.raises(OSError):
        sinks.write_with_retry("batch", broken, delay=0, totals=totals, sleep=waits.append)
    assert (totals.batches, totals.errors) == (1, 1)


def test_sender_listener(spark):
    import time

    df = spark.createDataFrame([reading(i) for i in range(7)], WIDE)
    listener = sinks.SenderListener()
    spark.streams.addListener(listener)
    try:
        table(spark, sinks.observed(stream(spark, df, df)))
        for _ in range(100):
            if listener.totals.records == 14:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert (listener.totals.records, listener.totals.batches, listener.totals.errors) == (14, 2, 0)
    assert listener.totals.processing_rate > 0


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([reading(i, i * 600, gpu=str(i % 2)) for i in range(12)], WIDE)
    path = str(tmp_path / "readings")
    write_readings(df, path)
    stored = read_readings(spark, path)
    assert rows(stored.select(*df.columns)) == rows(df)
    one_day = R.time_range(stored, "2024-01-02T00:00:00Z", "2024-01-02T23:59:59Z")
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert one_day.count() == rows(df.filter("date(ts) = '2024-01-02'")).__len__()
