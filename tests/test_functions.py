import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetmetrics.functions import checks as C
from fleetmetrics.functions import identity as I
from fleetmetrics.functions import parsing as P

NOW = "2024-02-01T12:00:00Z"


def test_to_float32(values):
    got = values(
        P.to_float32_or_zero,
        ["75.5", "", None, "abc", "1.0d", "1f", "1e39", "-1e39", "1e-50", " 1", "+.5", "5.", ".",
         "0x1p-2", "0x10", "1_000", "1e3", "inf", "-Infinity", "+nan", "1,5"],
    )
    assert got == [75.5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.5, 5, 0, 0.25, 0, 0, 1000,
                   math.inf, -math.inf, 0, 0]
    assert math.isnan(values(P.to_float32_or_zero, ["NaN"])[0])


def test_to_float64(values):
    assert values(P.to_float64_or_zero, ['"61.25"', "invalid", "", "1e39", "1e400", '" 1"']) == [
        61.25, 0.0, 0.0, 1e39, 0.0, 0.0]


def test_any_not_finite(values):
    one = lambda x: P.any_not_finite(x, F.lit("1.5"))
    assert values(one, ["1", "inf", "-Infinity", "NaN", "info", "x inf", "nano"]) == [
        False, True, True, True, False, False, False]


def test_parse_ts(spark):
    texts = ["2023-11-09T21:08:17Z", "2023-11-09T21:08:17.5Z", "2023-11-09T21:08:17+02:00",
             "2022-05-06 07:08:09", "2025", "no time at all", "", None, "2023-11-09T21:08:17",
             "2023-11-09T21:08:17Z\n", "2023-13-01T00:00:00Z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", P.rfc3339(P.parse_ts(F.col("t"), NOW)).alias("r")).orderBy("i").collect()
    now = "2024-02-01T12:00:00Z"
    assert [r.r for r in out] == [
        "2023-11-09T21:08:17Z", "2023-11-09T21:08:17Z", "2023-11-09T19:08:17Z",
        "2022-05-06T07:08:09Z", now, now, now, now, now, now, now]


def test_cleaning(values):
    assert values(P.clean_field, [' \t"a" ', '""', None, 'a"b', '"" x']) == ["a", "", "", 'a"b', " x"]
    assert values(P.sanitize, ["rack 7 node", "  rack 7 node  ", "rack 7\x00node",
                               "rack 7\x01\x02node", "rack 7\tnode\nend", "", " x　"]) == [
        "rack 7 node", "rack 7 node", "rack 7node", "rack 7node", "rack 7\tnode\nend", "", "x"]
    assert values(lambda x: P.first_non_empty(x, F.lit("b")), ["a", " ", None]) == ["a", "b", "b"]


def test_relative_time(values):
    texts = ["now", " NOW ", "now-5m", "now + 1 h", "now-1d", "now-30s", "now-5w", "now5m",
             "12", "", None, "now-99999999999d", "now-\n2h"]
    got = values(lambda x: P.rfc3339(P.resolve_relative_time(x, NOW)), texts)
    assert got == [
        "2024-02-01T12:00:00Z", "2024-02-01T12:00:00Z", "2024-02-01T11:55:00Z",
        "2024-02-01T13:00:00Z", "2024-01-31T12:00:00Z", "2024-02-01T11:59:30Z",
        None, None, None, None, None, None, "2024-02-01T10:00:00Z"]
    for text, want in zip(texts, got):
        if text is None:
            continue
        if want is None:
            with pytest.raises(ValueError):
                P.resolve_relative_time(text, NOW)
        else:
            assert P.resolve_relative_time(text, NOW).strftime("%Y-%m-%dT%H:%M:%SZ") == want


def test_relative_time_keeps_fractions(values):
    at = values(lambda x: P.resolve_relative_time(x, "2024-02-01T12:00:00.25Z"), ["now-1s"])[0]
    assert at.microsecond == 250_000


def test_headers_json(spark):
    df = spark.sql("select map('a','1','q','x\"y') as h union all select null union all select map()")
    assert [r[0] for r in df.select(P.headers_json(F.col("h"))).collect()] == [
        '{"a":"1","q":"x\\"y"}', "{}", "{}"]


def test_classify_key(values):
    keys = ["/t/cluster-1/hosts/host-1/gpus/gpu-0", "/t/cluster-1/hosts/host-1", "/t/cluster-1", "",
            None, "/t/cluster-1/data/gpu-0/2025-01-01", "/t/clusters/c/hosts/h/gpus/g/data",
            "/t/clusters/c/hosts/h/gpus/", "/t/clusters/c", "/t/clusters/c/hosts/h/gpus/g/data/p"]
    got = values(lambda x: I.classify_key(x), keys)
    assert [g.kind for g in got] == ["gpu", "host", "other", "other", "other", "data", "other",
                                     "other", "cluster", "data"]
    assert tuple(got[-1])[1:] == ("c", "h", "g", "p")
    assert (got[0].host, got[0].gpu) == ("host-1", "gpu-0")


def test_partition_key(spark):
    df = spark.createDataFrame([("test-host-1", "0")], "hostname string, gpu_id string")
    got = [df.select(I.partition_key(m)).first()[0] for m in ("hostname", "gpu_id", "none", "odd")]
    assert got == ["test-host-1", "0", "default", "default"]


def test_telemetry_id(spark):
    df = spark.sql("select 'h' as hostname, '0' as gpu_id, timestamp'2024-01-01 00:00:00.9Z' as ts")
    assert df.select(I.telemetry_id()).first()[0] == "h_0_1704067200"


def test_load_formula(spark):
    df = spark.createDataFrame(
        [(0.5, 0.6, 50.0), (0.8, 0.7, 80.0), (0.4, 0.5, 20.0), (0.0, 0.0, 500.0)],
        "cpu_usage double, memory_usage double, queue_depth double")
    got = [r[0] for r in df.select(I.instance_load()).collect()]
    assert got == pytest.approx([0.53, 0.77, 0.35, 0.4])
    assert df.select(I.instance_load({"cpu": 1.0})).first()[0] == pytest.approx(0.5)


def messages(values, check, inputs):
    return [None if r is None else (r.field, r.message) for r in values(check, inputs)]


@pytest.mark.parametrize("check,field,cases", [
    (C.check_gpu_id, "gpu_id", {
        "gpu-0": None, "gpu_0": None, "GPU-12345-abcde-67890": None, "": C.GPU_ID_REQUIRED,
        "g" * 101: C.GPU_ID_LONG, "g" * 100: None, "gpu@0": C.GPU_ID_INVALID,
        "gpu 0": C.GPU_ID_INVALID, "gpu-0\n": C.GPU_ID_INVALID, "é" * 51: C.GPU_ID_LONG}),
    (C.check_hostname, "hostname", {
        "gpu-node-01": None, "gpu-node-01.example.com": None, "": C.HOSTNAME_REQUIRED,
        "h" * 254: C.HOSTNAME_LONG, "h" * 253: None, "-invalid": C.HOSTNAME_INVALID,
        "x": C.HOSTNAME_INVALID, "a.": C.HOSTNAME_INVALID, "ab\n": C.HOSTNAME_INVALID}),
    (C.check_cluster_id, "cluster_id", {
        "production-cluster": None, "test_cluster_1": None, "": C.CLUSTER_ID_REQUIRED,
        "c" * 51: C.CLUSTER_ID_LONG, "cluster@1": C.CLUSTER_ID_INVALID}),
])
def test_id_checks(values, check, field, cases):
    want = [None if m is None else (field, m) for m in cases.values()]
    assert messages(values, check, list(cases)) == want


RANGES = [
    ("2024-02-01T11:00:00Z", "2024-02-01T12:00:00Z", None),
    ("", "", None),
    ("2024-02-01T11:00:00Z", "", None),
    ("invalid-time", "", ("start_time", C.START_INVALID)),
    ("", "invalid-time", ("end_time", C.END_INVALID)),
    ("2024-02-01T12:00:00Z", "2024-02-01T11:00:00Z", ("time_range", C.RANGE_REVERSED)),
    ("2022-02-01T11:59:59Z", "", ("start_time", C.START_OLD)),
    ("2022-02-01T12:00:00Z", "", None),
    ("", "2024-02-01T13:00:00Z", None),
    ("", "2024-02-01T13:00:01Z", ("end_time", C.END_AHEAD)),
    ("2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z", None),
    ("2024-01-01T00:00:00Z", "2024-01-31T00:00:01Z", ("time_range", C.RANGE_LONG)),
    ("2024-01-01T00:00:00+02:00", "2024-01-31T00:00:00+02:00", None),
]


def test_time_range_checks(spark):
    df = spark.createDataFrame(
        [(i, a, b) for i, (a, b, _) in enumerate(RANGES)], "i int, a string, b string")
    got = df.select("i", C.check_time_range(F.col("a"), F.col("b"), NOW).alias("e")).orderBy("i")
    assert [r.e and (r.e.field, r.e.message) for r in got.collect()] == [w for *_, w in RANGES]
    for a, b, want in RANGES:
        if want:
            with pytest.raises(C.CheckError) as raised:
                C.check_time_range(a, b, NOW)
            assert (raised.value.field, raised.value.message) == want
        else:
            assert C.check_time_range(a, b, NOW)[0] == (datetime.fromisoformat(a) if a else None)


def test_oldest_start_on_leap_day():
    assert C._oldest_start("2024-02-29T00:00:00Z").strftime("%m-%d") == "03-01"


def test_limit_checks(values):
    cases = {"50": None, "": None, "abc": C.LIMIT_INVALID, "0": C.LIMIT_POSITIVE,
             "-10": C.LIMIT_POSITIVE, "200": C.LIMIT_LARGE.format(100), "12abc": C.LIMIT_INVALID,
             "99999999999999999999": C.LIMIT_INVALID, "100": None}
    want = [None if m is None else ("limit", m) for m in cases.values()]
    assert messages(values, lambda x: C.check_limit(x, 100), list(cases)) == want
    for text, message in cases.items():
        if message:
            with pytest.raises(C.CheckError, match=message):
                C.check_limit(text, 100)
    assert (C.check_limit("50", 100), C.check_limit("", 100), C.check_limit("200")) == (50, None, 200)
    assert values(lambda x: C.limit_value(x, 100), ["50", "", "abc", "200"]) == [50, None, None, None]
    assert values(C.limit_value, ["5000000000"]) == [5000000000]


def test_literal_gpu_id():
    assert C.require_gpu_id("GPU_1-a") == "GPU_1-a"
    for bad in ("", "g" * 101, "gpu 0", "gpu\n"):
        with pytest.raises(C.CheckError):
            C.require_gpu_id(bad)
