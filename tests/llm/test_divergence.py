import random

import duckdb
import numpy as np
import pytest

from fleetmetrics.llm.divergence import divergences, shares
from fleetmetrics.llm.queries import OP11_SQL

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def sql_rows(rows):
    """The query's SQL twin over rows of (doc_id, text, lang, source)."""
    with duckdb.connect() as db:
        db.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
        if rows:
            db.executemany("insert into documents values (?, ?, ?, ?)", rows)
        return sorted(db.execute(f"select {', '.join(COLUMNS)} from ({OP11_SQL})").fetchall())


def spark_rows(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("n", "term", "k", "b", "bi", "total", "docs", "other", "value"):
        df = df.selectExpr("*", f"'x' as {name}")
    return sorted(tuple(r) for r in divergences(df.repartition(4), **sizes).select(COLUMNS).collect())


def corpus(seed, n=300, sources=7):
    rng = random.Random(seed)
    common = [f"w{a}{b}".translate(str.maketrans("0123456789", "abcdefghij")) for a in range(6) for b in range(10)]
    rows = []
    for i in range(n):
        source = "s0" if rng.random() < 0.4 else f"s{rng.randrange(sources)}"
        pick = common[: 20 + 5 * int(source[1:])]
        text = " ".join(rng.choice(pick) for _ in range(rng.randrange(30)))
        rows.append((i, text.title() if rng.random() < 0.2 else text, rng.choice(["en", "en", "de"]), source))
    return rows


ODD = [
    (1000, None, "en", "empty"), (1001, "", "en", "s1"), (1002, "1234 !!", "xx", "only"), (1003, None, None, None),
    (1004, "wab", None, "s1"), (1005, "Ärger ärger ÄRGER 漢字-漢字", "de", "s2"), (None, "wab wab", "en", "s3"),
    (1006, "wab " * 5000, "en", "s4"), (1006, "wab " * 5000, "en", "s4"), (1007, "a", "yy", "one"), (1008, "b", "yy", "two"),
] + [(1100 + i, "é漢 zz zz", "de", f"t{i % 2}") for i in range(12)]


@pytest.mark.parametrize("sizes", [{}, {"group_block": 2, "term_block": 7}, {"group_block": 1, "term_block": 100}])
def test_against_sql(spark, sizes):
    rows = corpus(1) + ODD
    found = spark_rows(spark, rows, **sizes)
    assert found == sql_rows(rows)
    assert any(r[0] == "yy" and r[4] == 0 for r in found) and any(r[3] == "漢" or r[3] == "é漢" for r in found)


def test_flushed_counts_add_up(spark, monkeypatch):
    from fleetmetrics.llm import divergence

    monkeypatch.setattr(divergence, "COUNTED_AT_ONCE", 50)
    rows = corpus(2, 200)
    assert spark_rows(spark, rows) == sql_rows(rows)


def test_few_rows(spark):
    assert spark_rows(spark, []) == []
    assert spark_rows(spark, [(1, "alone", "en", "s")]) == []
    assert spark_rows(spark, [(1, None, None, "s"), (2, None, None, None)]) == [
        ("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)
    ]


def test_shares_are_exact():
    rng = random.Random(3)
    total = [rng.randrange(1, 2**rng.randrange(1, 53)) for _ in range(2000)]
    count = [rng.randrange(t + 1) for t in total]
    found = shares(np.array(count), np.array(total))
    assert found.tolist() == [1 + 10**9 * c // t for c, t in zip(count, total)]
