import hashlib

import pytest
from pyspark.sql import functions as F

from fleetmetrics.operators.quality import drop_missing_identity
from fleetmetrics.operators.rollups import ingest_stats
from fleetmetrics.plans.ingest import ingest_folder
from fleetmetrics.sources import csv_files as S
from fleetmetrics.sources.messages import decode_messages

NOW = "2024-02-01T12:00:00Z"
WIDE = (
    "timestamp,gpu_id,uuid,device,model_name,hostname,gpu_utilization,memory_utilization,"
    "memory_used_mb,memory_free_mb,temperature,power_draw,sm_clock_mhz,memory_clock_mhz\n"
    "2024-03-05 07:08:09,0,GPU-aa10,card-a,L40S,rack7-n3,12.25,33.5,1024,45056,41,88.5,990,2505\n"
    "2024-03-05 07:08:10,1,GPU-aa11,card-b,L40S,rack7-n3,0,1.75,512,45568,38,61,210,405\n"
)
LONG_HEADER = (
    "timestamp,metric_name,gpu_id,device,uuid,modelName,Hostname,container,pod,namespace,value,labels_raw\n"
)


def put(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def by_gpu(df):
    return {r.gpu_id: r for r in df.collect()}


def test_wide_file(spark, tmp_path):
    rows = by_gpu(S.read_wide_csv(spark, put(tmp_path, a=WIDE), NOW))
    r = rows["0"]
    assert (r.hostname, r.uuid, r.model_name, r.temperature, r.gpu_utilization) == (
        "rack7-n3", "GPU-aa10", "L40S", 41.0, 12.25)
    assert (r.ts.isoformat(), r.cluster_id, r.reject_reason) == (
        "2024-03-05T07:08:09", "default-cluster", None)


def test_files_with_different_headers_bind_by_name(spark, tmp_path):
    other = (
        " HOST ,Hostname,TEMPERATURE,gpu,GPU_ID,modelName,timestamp,extra,hostname\n"
        "h0,h1,71.5,9,,A100,2024-01-01T00:00:00Z,x,h2\n"
        "h0,h1,72.5,9,7,A100,2024-01-01T00:00:00Z,x, \n"
        "h0,h1,73.5,9,8\n"
        "h0,h1,74.5,9,6,A100,2024-01-01T00:00:00Z,x,h3,more,and more\n"
    )
    folder = put(tmp_path, a=WIDE, b=other, c="timestamp,gpu_id\n2024-01-01T00:00:00Z,5\n")
    rows = by_gpu(S.read_wide_csv(spark, folder, NOW))
    assert set(rows) == {"0", "1", "9", "7", "8", "6"}
    # The last of equal names wins; "host" steps in only where it is blank.
    assert [(g, rows[g].hostname, rows[g].temperature, rows[g].model_name) for g in "9786"] == [
        ("9", "h2", 71.5, "A100"), ("7", "h0", 72.5, "A100"), ("8", "h0", 73.5, ""),
        ("6", "h3", 74.5, "A100")]
    assert rows["0"].temperature == 41.0


def test_rejects(spark, tmp_path):
    text = (
        "timestamp,gpu_id,hostname,temperature\n2024-01-01T00:00:00Z,0,h,1\n"
        "2024-01-01T00:00:00Z,,h,1\n2024-01-01T00:00:00Z,1,,1\n2024-01-01T00:00:00Z,2,h,NaN\n"
        "2024-01-01T00:00:00Z,3,h,1e39\n"
    )
    all_rows = S.read_wide_csv(spark, put(tmp_path, a=text), NOW)
    good, rejected = drop_missing_identity(all_rows)
    assert {r.gpu_id: r.temperature for r in good.collect()} == {"0": 1.0, "3": 0.0}
    assert sorted(r.reject_reason for r in rejected.collect()) == [
        "metric is not a finite number", "missing required fields", "missing required fields"]
    stats = ingest_stats(good, rejected, 2.0).first()
    assert (stats.processed, stats.total, stats.skipped, stats.records_per_second) == (2, 5, 3, 1.0)
    assert good.count() + rejected.count() == all_rows.count()


def test_quoted_newlines_commas_and_quotes(spark, tmp_path):
    text = 'timestamp,gpu_id,"host""name",hostname,temperature\n2024-01-01T00:00:00Z,0,"a,b","h\n1",3\n'
    row = S.read_wide_csv(spark, put(tmp_path, a=text), NOW).first()
    assert row.hostname == "h\n1"


def test_processing_time(spark, tmp_path):
    row = S.read_wide_csv(spark, put(tmp_path, a=WIDE), NOW, timestamp_mode="processing").first()
    assert row.ts.isoformat() == "2024-02-01T12:00:00"


def test_missing_headers_are_listed(spark, tmp_path):
    folder = put(tmp_path, a="timestamp,value\n2024-01-01T00:00:00Z,5\n")
    with pytest.raises(ValueError, match=r"missing required headers: \[gpu_id hostname\]"):
        S.read_wide_csv(spark, folder, NOW)
    with pytest.raises(ValueError, match=r"\[hostname\]"):
        S.check_required_columns(spark.createDataFrame([], " Timestamp string, GPU_ID string"))


def test_long_file(spark, tmp_path):
    text = LONG_HEADER + (
        '"2024-05-06T01:02:03Z","DCGM_FI_DEV_GPU_UTIL","0","card-a","GPU-bb20","L4",'
        '"node-q","","","","17.25","u=""9"",w=""8"""\n'
        "no time,DCGM_FI_DEV_GPU_TEMP,1,card-a,GPU-bb20,L4,node-q,,,,no number,p=q\n"
        "2024-05-06T01:02:03Z,DCGM_FI_DEV_GPU_UTIL,2\n"
    )
    rows = by_gpu(S.read_long_csv(spark, put(tmp_path, a=text), NOW))
    assert (rows["0"].value, rows["0"].hostname, rows["0"].model_name) == (17.25, "node-q", "L4")
    assert rows["0"].labels_raw == 'u="9",w="8"'
    assert (rows["1"].value, rows["1"].ts.isoformat()) == (0.0, "2024-02-01T12:00:00")
    assert (rows["2"].device, rows["2"].value, rows["2"].metric_name) == ("", 0.0, "DCGM_FI_DEV_GPU_UTIL")


def test_long_header_is_case_sensitive(spark, tmp_path):
    text = LONG_HEADER.replace("Hostname", "hostname") + "2024-05-06T01:02:03Z,m,0,d,u,mo,node-q,,,,1,\n"
    assert S.read_long_csv(spark, put(tmp_path, a=text), NOW).first().hostname == ""


def test_file_selection(spark, tmp_path):
    put(tmp_path, a="x\n", big="x" * 50)
    (tmp_path / "B.CSV").write_text("y\n")
    (tmp_path / "c.txt").write_text("z\n")
    files = S.select_input_files(spark, str(tmp_path), max_bytes=10)
    assert {r.filename for r in files.collect()} == {"a.csv", "B.CSV"}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()


def test_manifest(spark, tmp_path):
    short = "gpu_id,value\n0,5\n"
    folder = put(tmp_path, good=WIDE + "2024-03-05 07:08:10,,,,,,1\n", bad=short)
    rows = {r.filename: r for r in S.ingest_manifest(spark, folder, NOW).collect()}
    good, bad = rows["good.csv"], rows["bad.csv"]
    assert (good.record_count, good.total_records, good.skipped_records) == (2, 3, 1)
    assert (good.status, good.error, good.headers[0]) == ("processed", "", "timestamp")
    assert (bad.status, bad.record_count) == ("error", 0)
    assert bad.error == "missing required headers: [timestamp hostname]"
    assert bad.md5_hash == hashlib.md5(short.encode()).hexdigest()
    assert bad.file_id.endswith("_bad.csv")


def test_manifest_of_unusable_files(spark, tmp_path):
    rows = S.ingest_manifest(spark, put(tmp_path, a="gpu_id\n1\n", b="x\n"), NOW).collect()
    assert [r.status for r in rows] == ["error", "error"] and all(r.total_records == 0 for r in rows)


def test_ingest_folder(spark, tmp_path):
    done = ingest_folder(spark, put(tmp_path, a=WIDE), NOW)
    records = decode_messages(done.messages)[0]
    assert by_gpu(records)["1"].timestamp == "2024-03-05T07:08:10Z"
    assert done.messages.select("stream_key").distinct().count() == 2


def test_decode(spark):
    payloads = ['{"gpu_id":"1","temperature":5}', "{broken", '{"gpu_id":"2","temperature":"hot"}', None,
                '{"GPU_ID":"x"}', "", "  ", '{"gpu_id":"3"} and more',
                '{"gpu_id":"3"} {"gpu_id":"4"}', '{"gpu_id":"3"},', "[]"]
    df = spark.createDataFrame(
        [(str(i), p.encode() if p is not None else None) for i, p in enumerate(payloads)],
        "message_id string, payload binary")
    good, bad = decode_messages(df)
    rows = {r.message_id: r for r in good.collect()}
    assert set(rows) == {"0", "4"} and {r.message_id for r in bad.collect()} == {"1", "2", "3", "5", "6", "7", "8", "9", "10"}
    assert (rows["0"].temperature, rows["0"].power_draw, rows["0"].hostname) == (5.0, 0.0, "")
    assert rows["4"].gpu_id == ""
    assert good.filter(F.col("gpu_id") == "1").count() == 1


def test_clashing_and_odd_header_names(spark, tmp_path):
    wide = "timestamp,gpu_id,Hostname,source_file,temperature,a.b,`c`\n2024-01-01T00:00:00Z,0,h,elsewhere,5,1,2\n"
    row = S.read_wide_csv(spark, put(tmp_path, a=wide), NOW).first()
    assert (row.hostname, row.temperature) == ("h", 5.0) and row.source_file.endswith("a.csv")
    long = LONG_HEADER.strip() + ",hostname\n2024-01-01T00:00:00Z,m,0,d,u,mo,upper,,,,1,x,lower\n"
    (tmp_path / "a.csv").write_text(long)
    assert S.read_long_csv(spark, str(tmp_path), NOW).first().hostname == "upper"


def test_large_files_are_read_unless_refused(spark, tmp_path):
    folder = put(tmp_path, a=WIDE, big=WIDE + "2024-03-05 07:08:11,2,u,d,m,h,1,1,1,1,1,1,1,1\n" * 50)
    assert S.read_wide_csv(spark, folder, NOW).count() == 54
    rows = {r.filename: r for r in S.ingest_manifest(spark, folder, NOW, max_bytes=1000).collect()}
    assert (rows["a.csv"].status, rows["big.csv"].status) == ("processed", "error")
    assert rows["big.csv"].error == "file is larger than 1000 bytes"


def test_long_files_in_the_jobs(spark, tmp_path):
    long = LONG_HEADER + (
        "2024-01-01T00:00:00.1Z,DCGM_FI_DEV_GPU_TEMP,0,d,u,mo,h,,,,91.5,\n"
        "2024-01-01T00:00:00.2Z,DCGM_FI_DEV_GPU_UTIL,0,d,u,mo,h,,,,7,\n"
        "2024-01-01T00:00:00.2Z,DCGM_FI_DEV_GPU_UTIL,1,d,u,mo,,,,,7,\n"
    )
    folder = put(tmp_path, a=WIDE, b=long, c="timestamp,gpu_id,hostname\n2024-01-01T00:00:00Z,9,h\n")
    done = ingest_folder(spark, folder, NOW)
    rows = {(r.hostname, r.gpu_id): r for r in decode_messages(done.messages)[0].collect()}
    assert set(rows) == {("rack7-n3", "0"), ("rack7-n3", "1"), ("h", "0")}
    assert (rows["h", "0"].temperature, rows["h", "0"].gpu_utilization) == (91.5, 7.0)
    assert [r.reject_reason for r in done.rejected.collect()] == ["missing required fields"]
    states = {r.filename: (r.status, r.record_count) for r in S.ingest_manifest(spark, folder, NOW).collect()}
    assert states == {"a.csv": ("processed", 2), "b.csv": ("processed", 3), "c.csv": ("error", 0)}


def test_header_pass_reads_no_contents(spark, tmp_path):
    """A sparse file above 2 GiB is listed, has its header, and is read in parts."""
    import os

    put(tmp_path, a=WIDE)
    big = tmp_path / "big.csv"
    big.write_text("timestamp,gpu_id,hostname,temperature\n2024-01-01T00:00:00Z,7,h,5\n")
    os.truncate(big, 2**31 + 4096)
    found = {r.filename: r for r in S.file_headers(spark, str(tmp_path)).collect()}
    assert found["big.csv"].size == 2**31 + 4096 and found["big.csv"].headers[-1] == "temperature"
    plan = S.file_headers(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "FileScan" not in plan
    assert len(S.layouts(spark, str(tmp_path))) == 2
    states = {r.filename: r.status for r in S.ingest_manifest(spark, str(tmp_path), NOW, max_bytes=10**6).select("filename", "status").collect()}
    assert states == {"a.csv": "processed", "big.csv": "error"}


def test_file_heads(tmp_path):
    import io

    from fleetmetrics.sources import file_heads as H

    assert H.first_line(io.BytesIO(b"\r\n\na,b\r\nc")) == b"a,b" and H.first_line(io.BytesIO(b"")) == b""
    wide = b",".join(b"c%d" % i for i in range(60_000))
    assert len(wide) > 2 * H.FIRST_BLOCK and H.first_line(io.BytesIO(wide + b"\nx")) == wide
    assert H.first_line(io.BytesIO(b"x" * (H.MAX_HEADER + 1))) == b""
    assert H.header_cells(b'a,"b ""c"", d",') == ["a", 'b "c", d', ""] and H.header_cells(b"") == [""]


def test_large_files_are_split_unless_a_field_holds_a_line_break(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SPLIT_BYTES", 100)
    lines = "".join(f"2024-01-01T00:00:{i:02d}Z,{i},h,1\n" for i in range(60))
    header = "timestamp,gpu_id,hostname,temperature\n"
    folder = put(
        tmp_path, plain=header + lines, quoted=header + '2024-01-01T00:00:00Z,x,"h\n2",3\n' + lines,
        small=header + "2024-01-01T00:00:00Z,y,h,1\n",
    )
    conf = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(conf, 500)
    spark.conf.set("spark.sql.files.openCostInBytes", 10)
    try:
        rows = S.read_wide_csv(spark, folder, NOW)
        assert rows.rdd.getNumPartitions() > 4
        by_host = {(r.gpu_id, r.hostname) for r in rows.collect()}
        assert rows.count() == 122 and ("x", "h\n2") in by_host and ("59", "h") in by_host
    finally:
        spark.conf.unset(conf)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_many_layouts(spark, tmp_path, monkeypatch):
    """Files of more layouts than there may be scans give the same rows, also with odd characters in their names."""
    import itertools

    folder = tmp_path / "a b[1]{x}"
    folder.mkdir()
    for i, order in enumerate(itertools.permutations(("timestamp", "gpu_id", "hostname", "temperature"))):
        values = {"timestamp": "2024-01-01T00:00:00Z", "gpu_id": str(i), "hostname": "h", "temperature": str(i)}
        (folder / f"c+é%{i}.csv").write_text(",".join(order) + "\n" + ",".join(values[c] for c in order) + "\n")
    want = [(str(i), float(i)) for i in range(24)]
    for most in (64, 3):
        monkeypatch.setattr(S, "MAX_SCANS", most)
        rows = S.read_wide_csv(spark, str(tmp_path), NOW).collect()
        assert sorted((r.gpu_id, r.temperature) for r in rows) == sorted(want)
        assert len({r.source_file for r in rows}) == 24
    manifest = S.ingest_manifest(spark, str(tmp_path), NOW).collect()
    assert [(r.status, r.record_count) for r in manifest] == [("processed", 1)] * 24


def test_custom_metrics(spark, tmp_path, monkeypatch):
    """Finite numbers under other names, from files of different headers, through messages and back."""
    from fleetmetrics.plans.collect import collect_messages

    a = "timestamp,gpu_id,hostname,temperature,Fan_RPM,note\n2024-01-01T00:00:00Z,0,h,1,1500.5,x\n2024-01-01T00:00:00Z,1,h,1,,7\n"
    b = "timestamp,gpu_id,hostname,temperature,ecc errors,\n2024-01-01T00:00:00Z,2,h,1, 3 ,9\n2024-01-01T00:00:00Z,3,h,1,NaN,1\n"
    folder = put(tmp_path, a=a, b=b, c="timestamp,gpu_id,hostname,temperature\n2024-01-01T00:00:00Z,4,h,1\n")
    want = {"0": {"fan_rpm": 1500.5}, "1": {"note": 7.0}, "2": {"ecc errors": 3.0}, "3": {}, "4": {}}
    for most in (64, 0):
        monkeypatch.setattr(S, "MAX_SCANS", most)
        points = collect_messages(ingest_folder(spark, folder, NOW).messages, NOW).points
        assert {r.gpu_id: r.custom_metrics for r in points.collect()} == want
    assert "custom_metrics" not in S.read_readings_csv(spark, folder, NOW).columns
    plain = ingest_folder(spark, put(tmp_path / "..", d=WIDE) and str(tmp_path / ".." / "d.csv"), NOW)
    assert b"custom_metrics" not in bytes(plain.messages.first().payload)


def test_one_value_that_is_not_finite(spark, tmp_path):
    """The other metrics of its second stay; the value is told as a reject."""
    at = "2024-05-06T01:02:03Z"
    text = LONG_HEADER + "".join(
        f"{at},{m},0,d,u,mo,h,,,,{v},\n"
        for m, v in (("temperature", "40"), ("temperature", "NaN"), ("power_draw", "inf"), ("gpu_utilization", "7"))
    ) + f"{at},temperature,1,d,u,mo,h,,,,NaN,\n"
    good, rejected = drop_missing_identity(S.read_readings_csv(spark, put(tmp_path, a=text), NOW))
    assert [(r.gpu_id, r.temperature, r.power_draw, r.gpu_utilization) for r in good.collect()] == [("0", 40.0, 0.0, 7.0)]
    assert sorted((r.gpu_id, r.reject_reason) for r in rejected.collect()) == [
        ("0", "metric is not a finite number"), ("1", "metric is not a finite number")]


def test_messages_of_one_moment_go_by_their_files_seq(spark, tmp_path):
    """A row without a seq comes first, as does a lower one; rows equal in every field are one message."""
    from fleetmetrics.plans.collect import collect_messages

    at = "2024-01-01T00:00:00Z,0,h"
    seqs = ["9", "-3", "10", "", "x", "1e30", "100", "100", "0"]
    text = "timestamp,gpu_id,hostname,temperature,SEQ\n" + "".join(f"{at},{40 + i // 7 * 7},{s}\n" for i, s in enumerate(seqs))
    done = ingest_folder(spark, put(tmp_path, a=text), NOW)
    sent = done.messages.select("stream_key", F.get_json_object(F.col("payload").cast("string"), "$.custom_metrics.seq").alias("s"))
    order = [r.s and float(r.s) for r in sorted(sent.collect())]
    assert order[-6:] == [-3.0, 0.0, 9.0, 10.0, 100.0, 100.0] and len(order) == 8
    assert [r.custom_metrics["seq"] for r in collect_messages(done.messages, NOW).points.collect()] == [100.0]
