import math
import random

import pytest
from pyspark.sql import functions as F

from fleetmetrics.llm.negatives import hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
KIND = "vec_id long, label int, embedding array<double>"


def brute(rows, asks, positives=5, negatives=5, low=80, high=100):
    whole = [
        (key, label, [math.floor(256 * x) for x in v]) for key, label, v in rows
        if key is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, kind, a in whole:
        if not asks(q):
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b)), c, of) for c, of, b in whole if c != q and len(a) == len(b)
        )
        for best, positive, _ in [s for s in scored if s[2] == kind][:positives]:
            inside = [s for s in scored if s[2] != kind and low * -best <= 100 * -s[0] <= high * -best]
            out += [(q, positive, rank, c, -best, -s) for rank, (s, c, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(df, asks, **options):
    return sorted(tuple(r) for r in hard_negatives(df, asks, **options).select(COLUMNS).collect())


def odd_rows():
    rng = random.Random(7)
    rows = [(i, rng.randrange(4), [rng.uniform(-0.2, 0.6) for _ in range(5)]) for i in range(300)]
    rows += [(i, rng.randrange(3), [0.25, 0.5, 0.0, 0.0, 0.125]) for i in range(300, 420)]  # one common vector: ties
    rows += [(i, 9, [0.3] * 5) for i in (-10, -3, 425)]  # ids below 0, a small label
    rows += [(500, 1, None), (510, None, [0.1] * 5), (520, 1, [None, 1.0]), (530, 1, [math.nan] * 5)]
    rows += [(540, 2, [math.inf] * 5), (None, 1, [0.1] * 5), (550, 7, [0.1] * 5), (560, 1, [0.5, 0.5]), (561, 1, [0.5, 1.0])]
    rows += [(562, 2, [0.5, 0.75]), (570, 1, [])]
    rows += [(600, 1, [0.2] * 5)] * 3 + [(610, 1, [-0.5, 0.0, 0.0, 0.0, 0.0]), (620, 8, [0.0] * 5), (621, 8, [0.0] * 5)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"anchor_block": 7, "candidate_block": 40}, {"positives": 2, "negatives": 3, "low": 50, "high": 90}])
def test_against_all_pairs(spark, sizes):
    rows = odd_rows()
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as id", "2 as part", "3 as at", "'x' as anchor", "4 as score")
    options = {k: v for k, v in sizes.items() if "block" not in k}
    found = mined(df.repartition(5), F.col("vec_id") % 10 == 0, **sizes)
    assert found == brute(rows, lambda q: q % 10 == 0, **options)
    assert len(found) > 200


def test_a_negative_with_the_score_of_its_positive(spark):
    """It belongs to the window, whether its id is the smaller or the greater one."""
    rows = [(0, 1, [1.0]), (5, 1, [1.0]), (1, 2, [1.0]), (9, 2, [1.0]), (3, 2, [0.79]), (4, 2, [0.8]), (6, 2, [1.01])]
    df = spark.createDataFrame(rows, KIND)
    assert [r[3] for r in mined(df, F.col("vec_id") == 0)] == [1, 9] + [4] * (256 * math.floor(256 * 0.8) * 100 >= 80 * 256 * 256)


def test_large_components_are_exact(spark):
    rows = [(0, 1, [2.0**16 + 1 / 256, 3.0]), (1, 1, [2.0**20 + 3 / 256, 1.0]), (2, 2, [2.0**20 + 1 / 256, 5.0]),
            (3, 2, [2.0**20 + 1 / 256, 4.0])]
    df = spark.createDataFrame(rows, KIND)
    found = mined(df, F.col("vec_id") == 0)
    assert found == brute(rows, lambda q: q == 0) and len(found) == 2 and found[0][4] > 2**52


def test_few_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert mined(empty, F.col("vec_id") % 2 == 0) == []
    assert mined(spark.createDataFrame([(2, 1, [1.0])], KIND), F.col("vec_id") % 2 == 0) == []
    other = spark.createDataFrame([(2, 1, [1.0]), (4, 2, [1.0])], KIND)
    assert mined(other, F.col("vec_id") % 2 == 0) == []
    with pytest.raises(ValueError):
        hard_negatives(other, F.col("vec_id") == 2, high=120)
