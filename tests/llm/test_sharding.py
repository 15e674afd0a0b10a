import collections
import struct
import zlib

import pytest
import xxhash

from fleetmetrics.llm.sharding import shard_documents


def bits(key: int, shard: int) -> int:
    seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return xxhash.xxh64_intdigest(struct.pack("<q", shard), seed) >> 12


def test_shards_sizes_and_checksums(spark, documents, tables):
    rows = tables("select doc_id, text from documents")
    found = shard_documents(documents(rows), [1.0] * 16, 1.0, slot_parts=3).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for row in found:
        body = (texts[row.doc_id] or "").encode()
        assert (row.size, row.text_crc32) == (len(body) + 1, zlib.crc32(body))
        assert row.shard == max(range(16), key=lambda s: bits(row.doc_id, s))
        assert row.grown_shard == max(range(17), key=lambda s: bits(row.doc_id, s))
        assert row.grown_shard in (row.shard, 16)
    slots = collections.defaultdict(list)
    for row in found:
        slots[row.shard].append(row.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edge_rows(documents, edges):
    found = shard_documents(documents(edges), [1.0, 2.0, 0.0]).collect()
    assert len(found) == len(edges)
    assert {r.shard for r in found} <= {0, 1}
    by_id = collections.defaultdict(set)
    for row in found:
        by_id[row.doc_id].add(row.shard)
    assert all(len(s) == 1 for s in by_id.values())
    assert {(r.size, r.text_crc32) for r in found if r.doc_id in (1, 2, 7)} == {(1, 0)}
    assert sorted((r.shard, r.slot) for r in found) == sorted(set((r.shard, r.slot) for r in found))


def test_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    counts = {r.shard: r["count"] for r in shard_documents(docs, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(counts[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        shard_documents(docs, [])


def test_no_rows(documents):
    assert shard_documents(documents([]), [1.0]).count() == 0
