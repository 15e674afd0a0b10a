import math
import random

import pytest
from pyspark.sql import functions as F

from fleetmetrics.llm.topk import top_k


def brute(rows, asks, k):
    whole = [
        (key, [math.floor(256 * x) for x in v]) for key, v in rows
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in whole:
        if asks(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in whole if c != q and len(a) == len(b))
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("digit_bits", [3, 12])
def test_against_all_pairs(spark, digit_bits):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-0.5, 0.5) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.25, 0.5, 0.0, 0.0, -0.5, 0.125]) for i in range(300, 420)]  # one common vector: ties
    rows += [(500, None), (505, [None, 1.0]), (510, [math.nan] * 6), (515, [math.inf] * 6), (None, [0.1] * 6)]
    rows += [(520, [0.5, 0.5]), (521, [0.25, 1.0]), (530, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as part", "3 as at")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = top_k(df.repartition(5), F.col("vec_id") % 10 == 0, query_block=16, candidate_block=50, digit_bits=digit_bits)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, lambda q: q % 10 == 0, 5)


def test_repeated_query_rows_are_answered_each(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [0.5]), (2, [-1.0])], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in top_k(df, F.col("vec_id") == 0).collect())
    assert found == [(0, 1, 1, 32768)] * 2 + [(0, 2, 2, -65536)] * 2


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 2 == 0).count() == 0
    lone = spark.createDataFrame([(2, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(lone, F.col("vec_id") % 2 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [2.0**20 + i / 256, -3.0 * i, 2.0**15]) for i in range(12)] + [(20, [2.0**21, 0.0, 1.0]), (21, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(df.repartition(3), F.col("vec_id") % 2 == 0, query_block=3)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, lambda q: q % 2 == 0, 5)
    df = spark.createDataFrame([(0, [2.0**30]), (1, [2.0**30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="62 bits"):
        top_k(df, F.col("vec_id") == 0).collect()
