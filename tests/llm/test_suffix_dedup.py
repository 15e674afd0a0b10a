import hashlib
import random

import numpy as np
import pytest

from fleetmetrics.llm.suffix_arrays import common_prefixes, suffix_array
from fleetmetrics.llm.suffix_dedup import Repeats, removal_digests, remove_repeats


def flat(pieces):
    return (
        np.array([x for p in pieces for x in p], np.uint8),
        np.cumsum([0, *map(len, pieces)]).astype(np.int64),
    )


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_common_prefixes(seed):
    rng = random.Random(seed)
    pieces = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(6))]
    body, bounds = flat(pieces)
    every = sorted(
        ((*p[i:], nth - 1000), int(bounds[nth]) + i) for nth, p in enumerate(pieces) for i in range(len(p))
    )
    order = suffix_array(body, bounds)
    assert order.tolist() == [place for _, place in every]

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) - 1 and a[n] == b[n]:
            n += 1
        return n

    expected = [shared(a, b) for (a, _), (b, _) in zip(every, every[1:])]
    assert common_prefixes(body, bounds, order).tolist() == [0] * bool(every) + expected


def brute(rows, length):
    """Whether each byte goes, for each row, from all strings in a dictionary."""
    seen: dict[bytes, list] = {}
    bodies = [(t or "").encode() for _, t in rows]
    for row, body in enumerate(bodies):
        for i in range(len(body) - length + 1):
            seen.setdefault(body[i:i + length], []).append((row, i))
    gone = [np.zeros(len(b), bool) for b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for row, i in places:
                gone[row][i:i + length] = True
    return bodies, gone


def digest(body, gone):
    kept = bytes(np.frombuffer(body, np.uint8)[~gone])
    runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
    return len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 60)))]
        if rng.random() < 0.5:
            parts.append(passage[rng.randrange(20):])
        parts.append(" ".join(rng.choices(words, k=rng.randrange(0, 60))))
        out.append(rng.choice(["", "x"]).join(parts))
    out += rng.choices(out, k=10)
    edited = list(out[0])
    edited[len(edited) // 2] = "Z"
    return [*out, "".join(edited), "ab" * 300, passage]


@pytest.mark.parametrize("shard_bytes", [600_000, 700])
def test_removal_against_every_string(documents, shard_bytes):
    rows = list(enumerate(texts(3)))
    how = Repeats(length=60, gram=16, shard_bytes=shard_bytes)  # 700 bytes: anchors over several shards
    found = {r.doc_id: tuple(r)[1:] for r in removal_digests(documents(rows), how=how).collect()}
    bodies, gone = brute(rows, 60)
    assert found == {k: digest(b, g) for (k, _), b, g in zip(rows, bodies, gone)}
    assert sum(g.sum() for g in gone) > 1000


def test_whole_table(spark, tables):
    rows = tables("select doc_id, text from documents")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: tuple(r)[1:] for r in removal_digests(df).collect()}
    bodies, gone = brute(rows, 200)
    assert found == {k: digest(b, g) for (k, _), b, g in zip(rows, bodies, gone)}


def test_edge_rows(documents, edges):
    found = sorted((tuple(r) for r in removal_digests(documents(edges)).collect()), key=str)
    bodies, gone = brute(edges, 200)
    assert found == sorted(((k, *digest(b, g)) for (k, _), b, g in zip(edges, bodies, gone)), key=str)


def test_text_left_is_utf8_and_columns_stay(documents):
    same = "é" * 150
    df = documents([(1, "a" + same + "b"), (2, "cc" + same + "d"), (3, None), (4, "short")])
    left = remove_repeats(df)
    assert left.columns == df.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: "ab", 2: "ccd", 3: None, 4: "short"}


def test_no_rows(documents):
    assert removal_digests(documents([])).count() == 0
    assert remove_repeats(documents([])).count() == 0
