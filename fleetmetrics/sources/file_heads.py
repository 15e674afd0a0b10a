"""What files begin with: header cells from the first block, and digests block by block.

Tasks open the files themselves, by pyarrow's file systems (local, HDFS, S3,
GCS, Azure), since no reader of Spark stops after a file's first line or takes
files above 2 GiB whole.
"""

from __future__ import annotations

import csv
import hashlib
import sys
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# The row code below travels with its tasks; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIRST_BLOCK = 64 * 1024
#: A first line longer than this is no header; the file then has no header cells.
MAX_HEADER = 1024 * 1024
DIGEST_BLOCK = 8 * 1024 * 1024
FILES_PER_TASK = 64

DESCRIBED = (
    "path string, source_file string, filename string, size long, uploaded_at timestamp, md5_hash string, "
    "headers array<string>"
)


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the file's path there."""
    for ours, theirs in (("s3a:", "s3:"), ("s3n:", "s3:"), ("gs:", "gs:")):
        if uri.startswith(ours):
            uri = theirs + uri[len(ours):]
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri[len("file:"):]).lstrip("/")
    return fs.FileSystem.from_uri(quote(unquote(uri), safe=":/@"))


def first_line(stream: pa.NativeFile) -> bytes:
    """The first line that is not empty, read in blocks that grow; nothing if it is longer than ``MAX_HEADER``."""
    begun, size = b"", FIRST_BLOCK
    while True:
        block = stream.read(size)
        begun = (begun + block).lstrip(b"\r\n")
        line, found, _ = begun.partition(b"\n")
        if found or not block:
            return line.rstrip(b"\r") if len(line) <= MAX_HEADER else b""
        if len(begun) > MAX_HEADER:
            return b""
        size *= 2


def header_cells(line: bytes) -> list[str]:
    text = line.decode("utf-8", "replace")
    return next(csv.reader([text]), [""]) if text else [""]


def md5_of(stream: pa.NativeFile) -> str:
    digest = hashlib.md5(usedforsecurity=False)
    while block := stream.read(DIGEST_BLOCK):
        digest.update(block)
    return digest.hexdigest()


def _describer(digest: bool):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                store, path = open_uri(uri)
                info = store.get_file_info(path)
                with store.open_input_file(path) as stream:
                    headers = header_cells(first_line(stream))
                md5 = None
                if digest:
                    with store.open_input_stream(path) as stream:
                        md5 = md5_of(stream)
                moment = datetime.fromtimestamp((info.mtime_ns or 0) // 1_000_000 / 1000, timezone.utc)
                rows.append((unquote(uri), uri, info.base_name, info.size, moment, md5, headers))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)] if rows else
                [pa.array([], field.type) for field in schema], schema=schema,
            )

    schema = pa.schema([
        ("path", pa.string()), ("source_file", pa.string()), ("filename", pa.string()), ("size", pa.int64()),
        ("uploaded_at", pa.timestamp("us", "UTC")), ("md5_hash", pa.string()), ("headers", pa.list_(pa.string())),
    ])
    return describe


def describe_files(spark: SparkSession, uris: Sequence[str], digest: bool = False) -> DataFrame:
    """One row per file: decoded path, URI, name, size, time, MD5 (if asked for) and header cells.

    Tasks take ``FILES_PER_TASK`` files each; with a digest, which reads all bytes, one.
    """
    tasks = max(1, len(uris) if digest else -(-len(uris) // FILES_PER_TASK))
    names = spark.sparkContext.parallelize([(uri,) for uri in uris], tasks)
    return spark.createDataFrame(names, "uri string", verifySchema=False).mapInArrow(_describer(digest), DESCRIBED)
