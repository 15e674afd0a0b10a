"""WARC archives as a Python data source.

Written archives hold one gzip member per record. A member's header carries its
length in an ``sl`` field, so a reader can step over a record after looking at
its first bytes. Reading plans whole files into partitions, takes over filters on
header columns, and decodes the payload only of records that pass them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names of the WARC standard, version 1.1; fixed values.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
# Field names have no case; these are given as the standard spells them.
_SPELT = {
    name.lower(): name
    for name in (*HEADERS.values(), "Content-Length", "Content-Type", "WARC-Profile", "WARC-Truncated", "WARC-IP-Address")
}
GZIP_START = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"  # deflate, with extra field, no time
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "refers_to string, payload_bytes long, headers map<string,string>, payload binary"
)
MANIFEST = "_written"  # each write leaves a list of its files, whose name begins so
FILE_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
FIRST_READ = 2048
BATCH_BYTES = 4 << 20
_OWN_FILE = re.compile(r"/part-[0-9a-f]{32}\.warc\.gz$")


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it: a local path, or a URI that pyarrow knows (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- one record


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(
    record_type: str, record_id: str, date: str, target_uri: str | None, payload: bytes, digest: str,
    refers_to: str | None,
) -> bytes:
    """One record; a revisit keeps the HTTP headers, and in them the payload's length, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if record_type == "response" else b"")
    lines = [
        ("WARC-Type", record_type), ("WARC-Record-ID", record_id), ("WARC-Date", date),
        ("WARC-Target-URI", target_uri), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", refers_to),
        ("WARC-Profile", REVISIT_PROFILE if record_type == "revisit" else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {_clean(value)}\r\n" for name, value in lines if value is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    extra = b"sl" + struct.pack("<H", 8) + struct.pack("<II", len(body) + 32, len(record) & 0xFFFFFFFF)
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    return GZIP_START + struct.pack("<H", len(extra)) + extra + body + tail


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """A record's header fields and where its block begins; None if the header is not all there."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    first, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = ((n.strip(), v.strip()) for n, _, v in (line.partition(":") for line in lines))
    return {_SPELT.get(n.lower(), n): v for n, v in fields}, end + 4


def parse_block(block: bytes, fields: dict[str, str]) -> tuple[bytes | None, int | None]:
    """The payload and the length of the full payload: without HTTP headers where the block has them."""
    if not fields.get("Content-Type", "").lower().startswith("application/http"):
        return block, len(block)
    head, _, payload = block.partition(b"\r\n\r\n")
    length = None
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            length = int(value)
    if fields.get("WARC-Type") == "revisit":
        return None, length
    return payload, len(payload)


def records(source: pa.NativeFile, size: int, wanted, with_payload: bool) -> Iterator[tuple[dict, bytes | None, int | None]]:
    """The records of one file, compressed or plain, whose header fields are ``wanted``.

    Headers come first: of a record that is not wanted the rest is stepped over
    where its length is known, and never decoded into a payload.
    """
    at = 0
    while at < size:
        source.seek(at)
        start = source.read(FIRST_READ)
        if start[:2] == b"\x1f\x8b":
            unpacker = zlib.decompressobj(31)
            length = struct.unpack("<I", start[16:20])[0] if start[3] & 4 and start[12:14] == b"sl" else None
            if length is not None:
                start = start[:length]
            data, taken = unpacker.decompress(start), len(start)

            def more(unpacker=unpacker, length=length) -> bytes:
                nonlocal taken
                want = 1 << 20 if length is None else min(1 << 20, length - taken)
                raw = source.read(want) if want else b""
                taken += len(raw)
                return unpacker.decompress(raw) if raw else b""

            while (parsed := parse_head(data)) is None and not unpacker.eof:
                if not (step := more()):
                    break
                data += step
            if parsed is None:
                raise ValueError(f"broken record at byte {at}")
            fields, body = parsed
            chosen = wanted(fields)
            if not chosen and length is not None:
                at += length
                continue
            pieces = [data]
            while not unpacker.eof and (step := more()):
                if chosen:
                    pieces.append(step)
            at = at + length if length is not None else at + taken - len(unpacker.unused_data)
            if chosen:
                block = b"".join(pieces)[body:body + int(fields.get("Content-Length", 0))]
        else:
            if not start.strip():
                return
            while (parsed := parse_head(start)) is None:
                if not (step := source.read(FIRST_READ)):
                    raise ValueError(f"broken record at byte {at}")
                start += step
            fields, body = parsed
            length = int(fields.get("Content-Length", 0))
            chosen = wanted(fields)
            if chosen:
                source.seek(at + body)
                block = source.read(length)
            at += body + length + 4
        if chosen:
            payload, full = parse_block(block, fields)
            yield fields, payload if with_payload else None, full


# ---------------------------------------------------------------- the data source


@dataclass
class _Files(InputPartition):
    paths: list[tuple[str, int]]


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _listed(store: fs.FileSystem, base: str, files: Iterable[fs.FileInfo]) -> list[str]:
    """The files that the writes to the folder have listed, and those that stand beside them."""
    names: list[str] = []
    lists = [x.path for x in files if x.base_name.startswith(MANIFEST) and x.path.count("/") == base.rstrip("/").count("/") + 1]
    for path in sorted(lists):
        with store.open_input_file(path) as f:
            names += json.loads(f.read())
    if names:
        prefix = base.rstrip("/") + "/"
        names += [
            x.path.removeprefix(prefix) for x in files
            if x.path.endswith((".warc", ".warc.gz")) and not _OWN_FILE.search(x.path)
        ]
    return names


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._path = options["path"]
        self._payload = options.get("payload", "true").lower() != "false"
        self._verify = options.get("verify", "false").lower() == "true"
        self._filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take over equality, membership, presence and prefix tests on header columns."""
        for one in filters:
            column = ".".join(one.attribute) if hasattr(one, "attribute") else ""
            if column in HEADERS and isinstance(one, (EqualTo, In, IsNotNull, StringStartsWith)):
                self._filters.append((type(one).__name__, HEADERS[column], getattr(one, "value", None)))
            else:
                yield one

    def _wanted(self, fields: dict[str, str]) -> bool:
        for kind, name, value in self._filters:
            own = fields.get(name)
            if own is None:
                return False
            if kind == "EqualTo" and own != value or kind == "In" and own not in value:
                return False
            if kind == "StringStartsWith" and not own.startswith(value):
                return False
        return True

    def partitions(self) -> list[_Files]:
        """Whole files, small ones together up to ``PARTITION_BYTES``."""
        store, base = open_store(self._path)
        listed = store.get_file_info(fs.FileSelector(base, recursive=True))
        archives = {x.path: x for x in listed if x.path.endswith((".warc", ".warc.gz"))}
        names = [f"{base}/{name}" for name in _listed(store, base, listed)]
        # Where this module wrote, files that no list names are those of tasks that failed.
        found = [archives[name] for name in names if name in archives] if names else [
            x for path, x in archives.items() if not _OWN_FILE.search(path)
        ]
        out: list[_Files] = []
        held = PARTITION_BYTES
        for one in sorted(found, key=lambda x: x.path):
            if held + one.size > PARTITION_BYTES:
                out.append(_Files([]))
                held = 0
            out[-1].paths.append((one.path, one.size))
            held += one.size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self._path)
        rows: list[tuple] = []
        held = 0
        for path, size in partition.paths:
            with store.open_input_file(path) as source:
                for fields, payload, full in records(source, size, self._wanted, self._payload):
                    if self._verify and payload is not None:
                        self._check(fields, payload)
                    rows.append((*(fields.get(name) for name in HEADERS.values()), full, list(fields.items()), payload))
                    held += len(payload or b"") + 500
                    if held > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _check(fields: dict[str, str], payload: bytes) -> None:
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields.get("WARC-Payload-Digest", digest) != digest:
            raise ValueError(f"the payload of {fields.get('WARC-Record-ID')} does not match its digest")

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        text = pa.string()
        kinds = [text] * len(HEADERS) + [pa.int64(), pa.map_(text, text), pa.binary()]
        names = [*HEADERS, "payload_bytes", "headers", "payload"]
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own; only those of tasks that succeeded are listed in the manifest."""

    def __init__(self, options: dict[str, str]) -> None:
        self._path = options["path"]
        self._date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, base = open_store(self._path)
        store.create_dir(base, recursive=True)
        files: list[str] = []
        out, held = None, 0
        for batch in iterator:
            columns = [batch.column(n) for n in ("record_type", "record_id", "target_uri", "payload", "payload_digest", "refers_to")]
            for kind, name, uri, payload, digest, refers in zip(*(c.to_pylist() for c in columns), strict=True):
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, held = store.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                member = gzip_member(record_bytes(kind, name, self._date, uri, payload or b"", digest, refers))
                out.write(member)
                held += len(member)
                if held >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, base = open_store(self._path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([name for m in messages if m for name in m.files]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, base = open_store(self._path)
        for name in (name for m in messages if m for name in m.files):
            store.delete_file(f"{base}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` with the options ``path``, ``payload`` and ``verify``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known; taking over filters is off in Spark unless it is asked for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of all archives below a folder.

    Filters on the header columns (``record_type``, ``record_id``, ``target_uri``,
    ``date``, ``payload_digest``, ``refers_to``) are applied while reading. Without
    ``payload`` that column is null. ``payload_bytes`` is the length of the full
    payload, for a revisit as its HTTP headers tell it. An empty folder gives no rows.
    """
    register(spark)
    return spark.read.format("warc").options(payload=str(payload), verify=str(verify)).load(path)


# ---------------------------------------------------------------- pages to archives


def base32(hex_digest: Column) -> Column:
    """A hex text whose length is a multiple of 5 in upper-case base 32, five digits to four."""
    parts = [
        F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0
) -> DataFrame:
    """A record for each page, ready to be written.

    Of the pages whose payloads are equal and have ``min_bytes`` or more, that with
    the least key is the response and the others are revisits of it; rows that
    repeat the least key are responses too. Smaller payloads are all responses.
    A null html is an empty payload; a null url leaves its header out. Pages with a
    null key are responses, and no revisit refers to them.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(key).alias("id"), F.col(url).alias("target_uri"), payload.alias("payload"),
        base32(F.sha1(payload)).alias("payload_digest"),
    )
    # What is compared by digest has no payloads; these move by digest and key, so that copies do not meet in a task.
    named_rows = rows.where(F.col("id").isNotNull() & (F.octet_length("payload") >= min_bytes))
    known = named_rows.select("payload_digest", "id").distinct()
    firsts = known.groupBy("payload_digest").agg(F.min("id").alias("first"))
    again = known.join(firsts, "payload_digest").where("id != first")
    named = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return rows.join(again, ["payload_digest", "id"], "left").select(
        F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"),
        F.coalesce(named("id"), F.lit("<urn:page:>")).alias("record_id"),
        "target_uri", "payload", "payload_digest", named("first").alias("refers_to"),
    )


def write_warc(records_: DataFrame, path: str) -> None:
    """Add archives with the records to a folder; what earlier writes left there stays."""
    register(records_.sparkSession)
    records_.write.format("warc").mode("append").save(path)
