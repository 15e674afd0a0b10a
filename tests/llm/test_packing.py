import collections
import itertools
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetmetrics.llm import packing
from fleetmetrics.llm.packing import (
    ByteBpe,
    best_fit,
    bin_completion,
    lower_bound,
    pack_documents,
    pack_pieces,
    public_vocabulary,
)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_of_words_are_those_of_the_text(tokenizer, tables):
    bpe = ByteBpe(**public_vocabulary())
    rng = random.Random(1)
    odd = ["a", "é", " ", "  ", "\n", ".", ",", "!", "'s", "'ll", "12", "漢", "<|endoftext|>", "\r\n", "I", "-", "²", "😀"]
    texts = [t for (t,) in tables("select text from documents")]
    texts += ["".join(rng.choices(odd, k=rng.randrange(12))) for _ in range(5000)]
    for text in texts:
        expected = ids(tokenizer, text)[:-1]
        assert bpe.ids(text) == struct.pack(f"<{len(expected)}I", *expected), text


def fewest(sizes, capacity):
    """Sequences of the best packing, by trying all."""
    best = len(sizes)

    def place(left, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not left:
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= left[0] and rooms[i] not in rooms[:i]:
                place(left[1:], [*rooms[:i], rooms[i] - left[0], *rooms[i + 1:]])
        place(left[1:], [*rooms, capacity - left[0]])

    place(sorted(sizes, reverse=True), [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_small_packings_are_optimal(sizes):
    counts = [0] * 21
    for size in sizes:
        counts[size] += 1
    found = bin_completion(counts, 20, nodes=100_000)
    assert sorted(itertools.chain(*found)) == sorted(sizes)
    assert all(sum(b) <= 20 for b in found)
    assert lower_bound(counts, 20) <= len(found) == fewest(sizes, 20) <= len(best_fit(counts, 20))


@pytest.mark.parametrize("least, most", [(1, 1024), (200, 500), (10, 90), (350, 700), (600, 600)])
def test_large_packings_stay_near_the_bound(least, most):
    rng = random.Random(2)
    sizes = [rng.randint(least, most) for _ in range(3000)]
    counts = [0] * 1025
    for size in sizes:
        counts[size] += 1
    found = bin_completion(counts, 1024)
    assert sorted(itertools.chain(*found)) == sorted(sizes) and max(map(sum, found)) <= 1024
    assert len(found) <= len(best_fit(counts, 1024))


def check(rows, texts, tokenizer, capacity):
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    expected = collections.defaultdict(list)
    for key, text in texts:
        own, start = ids(tokenizer, text), 0
        size = len(own) % capacity or capacity
        for nth in itertools.count():
            part = own[start:start + size]
            expected[key].append((nth, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
            start, size = start + size, capacity
            if start >= len(own):
                break
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    return len(sequences)


def test_whole_table(spark, tables, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack_documents(df).collect()
    used = check(rows, tables("select doc_id, text from documents"), tokenizer, 1024)
    assert used <= -(-sum(r.length for r in rows) // 1024) + 1


def test_edge_rows(documents, edges, tokenizer):
    rows = pack_documents(documents(edges)).collect()
    check(rows, edges, tokenizer, 1024)
    assert any(r.length == 1 and r.doc_id == 1 for r in rows)


def test_loose_sequences_of_groups_meet(spark):
    pieces = spark.range(2000).selectExpr("id as doc_id", "1 + (id * 7919) % 1024 as length")
    grouped = pack_pieces(pieces, group_pieces=100).collect()
    alone = pack_pieces(pieces).collect()
    count = lambda rows: len({r.sequence_id for r in rows})
    assert len(grouped) == len(alone) == 2000
    assert count(grouped) <= count(alone) * 1.05  # groups of 100 are far below what a task takes


def test_no_rows(documents):
    assert pack_documents(documents([])).count() == 0


def fewest(sizes, capacity):
    """The least number of sequences, by all subsets in the order of their bits."""
    n = len(sizes)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)  # sequences, and the fill of the last one
    for some in range(1 << n):
        count, fill = best[some]
        for i in range(n):
            if not some >> i & 1:
                step = (count, fill + sizes[i]) if count and fill + sizes[i] <= capacity else (count + 1, sizes[i])
                best[some | 1 << i] = min(best[some | 1 << i], step)
    return best[-1][0]


def counted(sizes, capacity):
    counts = [0] * (capacity + 1)
    for size in sizes:
        counts[size] += 1
    return counts


def test_search_that_ended_has_the_optimum():
    sizes = [2, 5, 5, 7, 9, 10, 11, 11]
    found, proven = packing.search(counted(sizes, 30), 30, 10**6)
    assert proven and len(found) == 2 and sorted(x for one in found for x in one) == sizes
    assert len(packing.bin_completion(counted([70, 25, 25, 25, 25, 30, 100, 100], 100), 100, 10**6)) == 4
    rng = random.Random(10)
    for _ in range(10_000):
        capacity = rng.randrange(8, 40)
        top = rng.choice([capacity, capacity // 2, capacity // 3 + 1])
        sizes = [rng.randrange(1, top + 1) for _ in range(rng.randrange(1, 9))]
        found, proven = packing.search(counted(sizes, capacity), capacity, 10**6)
        assert proven and all(sum(one) <= capacity for one in found)
        assert sorted(x for one in found for x in one) == sorted(sizes)
        assert len(found) == fewest(sizes, capacity), (capacity, sizes)


def test_a_cut_search_claims_nothing():
    rng = random.Random(3)
    sizes = [rng.randrange(200, 400) for _ in range(300)]
    found, proven = packing.search(counted(sizes, 1000), 1000, 5)
    assert not proven or len(found) == packing.lower_bound(counted(sizes, 1000), 1000)


def test_sequences_rebuild_the_texts(spark, documents, edges):
    """The ids of a document's pieces are those of its text, and a sequence's places hold them."""
    from tokenizers import Tokenizer

    rows = [*edges, (30, "word " * 3000)]
    found = packing.pack_documents(documents(rows), with_ids=True).collect()
    full = Tokenizer.from_file(packing.public_vocabulary()["json_path"])
    by_doc, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.ids))
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        assert sorted(spots)[0][0] == 0 and sum(n for _, n in spots) <= 1024
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spots), sorted(spots)[1:]))
    for key, text in rows:
        if key != 9:  # which is there twice
            ids = [i for _, part in sorted(by_doc[key]) for i in part]
            assert ids == [*full.encode(text or "", add_special_tokens=False).ids, 2]
    counter = packing.token_counter(packing.public_vocabulary())
    import pyarrow as pa

    assert counter(pa.array([t for _, t in rows])).tolist()[:2] == [1, 1]
