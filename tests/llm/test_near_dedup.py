import random

import pytest

from fleetmetrics.llm.components import components
from fleetmetrics.llm.near_dedup import NearCopies, near_copies


def sets_of(text, words):
    parts = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if len(parts) < words:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[i:i + words]) for i in range(len(parts) - words + 1)}


def brute(rows, words, percent):
    """Size of each set and the least id that links reach."""
    sets = [(k, sets_of(t, words)) for k, t in rows]
    parent = {k: k for k, _ in rows if k is not None}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, one) in enumerate(sets):
        for b, other in sets[:i]:
            if a is None or b is None or not one or not other:
                continue
            if 100 * len(one & other) >= percent * len(one | other):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return sorted(((k, len(s), None if k is None else find(k)) for k, s in sets), key=str)


def answer(df, how):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_copies(df, how).collect()), key=str)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links += [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7), (5000, 5000)]
    parent = {x: x for pair in links for x in pair}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: find(k) for k in parent}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(seed, copies=60):
    """A base and copies with more and more words changed, and documents of their own."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]
    base = rng.choices(words, k=120)
    out = []
    for n in range(copies):
        own = list(base)
        for _ in range(n % 12):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out + [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(60)]


@pytest.mark.parametrize("blocks", [{}, {"bucket_block": 8, "set_block": 900}])
def test_graded_copies(documents, blocks):
    rows = list(enumerate(edited(2)))
    random.Random(1).shuffle(rows)
    how = NearCopies(words=3, percent=85, **blocks)
    expected = brute(rows, 3, 85)
    assert answer(documents(rows), how) == expected
    assert sum(k != c for k, _, c in expected) > 10


def test_whole_table(spark, tables):
    rows = tables("select doc_id, text from documents")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert answer(df, NearCopies(words=3, percent=85)) == brute(rows, 3, 85)


def test_edge_rows(documents, edges):
    rows = [*edges, (20, "One TWO"), (21, "one  two\n")]
    how = NearCopies()
    assert answer(documents(rows), how) == brute(rows, 5, 80)
    kept = {(r.doc_id, r.kept) for r in near_copies(documents(rows), how).collect()}
    assert {(None, True), (1, True), (7, True), (5, True), (6, False), (20, False), (21, False)} <= kept


def test_no_rows(documents):
    assert near_copies(documents([])).count() == 0


@pytest.mark.parametrize("percent", [60, 70, 80, 85, 90, 100])
def test_bands_miss_few_pairs_at_the_threshold(percent):
    how = NearCopies(percent=percent)
    assert (1 - (percent / 100) ** how.rows) ** how.bands <= 1e-6
    assert how.samples >= how.bands * how.rows and len(how.multipliers()) == how.samples
    assert NearCopies(percent=85).bands == 24 and NearCopies(bands=7).bands == 7
