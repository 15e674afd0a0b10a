import base64
import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fleetmetrics.llm import warc
from fleetmetrics.session import shared_dir

PAGES = [
    (3, "http://a/", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (2, "http://c/\r\nX: y", "<p>é other</p>"),
    (4, None, None), (5, "http://d/", ""), (None, "http://e/", "<p>same</p>"), (6, "http://f/", "long " * 50_000),
    (7, "http://g/", "line\r\n\r\nWARC/1.1\r\n\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as id", "'y' as payload", "'z' as first")


@pytest.fixture(scope="module")
def archive(spark, pages):
    path = shared_dir(spark, "warc-test")
    warc.write_warc(warc.page_records(pages).repartition(3), path)
    return path


def test_round_trip(spark, archive):
    found = {r.record_id: r for r in warc.read_warc(spark, archive, verify=True).collect()}
    first = {"<p>same</p>": 1, "": 4}
    assert len(found) == len(PAGES)
    for key, url, page in PAGES:
        row = found[f"<urn:page:{'' if key is None else key}>"]
        body = (page or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        least = first.get(page or "", key)
        again = key is not None and key != least
        assert row.payload_digest == f"sha1:{digest}" and row.payload_bytes == len(body)
        assert row.record_type == ("revisit" if again else "response")
        assert row.refers_to == (f"<urn:page:{least}>" if again else None)
        assert row.payload == (None if again else body)
        assert row.target_uri == (None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))


def test_filters_are_taken_over(spark, archive):
    some = warc.read_warc(spark, archive).where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan warc" in plan and not re.search(r"\) Filter|^\W*Filter", plan, re.M)
    assert {r.record_id for r in some.collect()} == {"<urn:page:3>", "<urn:page:5>"}
    listed = warc.read_warc(spark, archive, payload=False).where(F.col("record_id").isin("<urn:page:1>", "<urn:page:9>"))
    assert [(r.record_id, r.payload) for r in listed.collect()] == [("<urn:page:1>", None)]


def test_unwanted_payloads_are_not_decoded(tmp_path, monkeypatch):
    import pyarrow as pa

    data = b"".join(
        warc.gzip_member(warc.record_bytes(kind, f"<{i}>", "d", "u", b"x" * 100_000, "D", None))
        for i, kind in enumerate(["response", "request", "response"])
    )
    read = []
    monkeypatch.setattr(warc, "parse_block", lambda block, fields: read.append(fields["WARC-Record-ID"]) or (block, len(block)))
    source = pa.BufferReader(data)
    list(warc.records(source, len(data), lambda f: f["WARC-Type"] == "request", True))
    assert read == ["<1>"]


def test_other_archives(spark, tmp_path):
    """Plain files, members without a length, and records that are no web pages."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    page = warc.record_bytes("response", "<p>", "d", "u", b"body", "D", None)
    (tmp_path / "a.warc").write_bytes(info + page)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page * 1))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    found = sorted((r.record_id, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert found == [("<i>", b"hello")] * 2 + [("<p>", b"body")] * 2


def test_small_payloads_are_responses(pages):
    kinds = {(r.record_id, r.record_type) for r in warc.page_records(pages, min_bytes=12).collect()}
    assert ("<urn:page:3>", "response") in kinds and ("<urn:page:5>", "response") in kinds


def test_no_pages(spark, pages):
    path = shared_dir(spark, "warc-empty")
    warc.write_warc(warc.page_records(pages.limit(0)), path)
    assert warc.read_warc(spark, path).count() == 0


def test_a_second_write_adds_to_the_first(spark, pages):
    """Files that a failed task left are not read; archives from elsewhere are."""
    path = shared_dir(spark, "warc-twice")
    for part in ("page_id <= 3", "page_id > 3"):
        warc.write_warc(warc.page_records(pages.where(part)).repartition(2), path)
    page = warc.record_bytes("response", "<foreign>", "d", "u", b"body", "D", None)
    store, base = warc.open_store(path)
    for name in ("part-" + "0" * 32 + ".warc.gz", "other.warc.gz"):
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(warc.gzip_member(page))
    found = sorted(r.record_id for r in warc.read_warc(spark, path).collect())
    assert found == sorted([f"<urn:page:{i}>" for i in range(1, 8)] + ["<foreign>"])


def test_header_names_have_no_case(spark, tmp_path):
    page = warc.record_bytes("response", "<p>", "d", "u", b"body", "D", None)
    head, _, block = page.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    small = b"\r\n".join([lines[0], *(n.lower() + b":" + v for n, _, v in (line.partition(b":") for line in lines[1:]))])
    (tmp_path / "a.warc").write_bytes(small + b"\r\n\r\n" + block + page)
    found = warc.read_warc(spark, str(tmp_path)).where("record_type = 'response'").collect()
    assert [(r.record_id, bytes(r.payload), r.payload_bytes) for r in found] == [("<p>", b"body", 4)] * 2


def test_many_copies_of_a_page(spark):
    """Copies meet by digest without their payloads."""
    df = spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, 'same', string(id)) as html")
    found = warc.page_records(df)
    assert found.groupBy("record_type", "refers_to").count().orderBy("count").collect()[0][1] == "<urn:page:0>"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    by_digest = [line for line in plan.split("\n") if "Join" in line]
    assert len(by_digest) == 2 and "id#" in by_digest[0] and "id#" not in by_digest[1].split("=")[-1]
