"""Hard negatives: rows of other labels that score nearly as high with an anchor as its own kind does.

First each anchor's best rows of its own label are found. Then all rows of other
labels are scored in blocks, and each block passes on only what can be among the
first of some window below a positive's score. What is left is packed into keys
(anchor, descending score, id) and dealt and sorted by them within partitions;
an iterator reads each anchor's keys from the highest score down, opens a window
at each positive and emits the negatives in it, holding nothing but open windows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors
from .tables import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANCHOR_BLOCK = 4096
CANDIDATE_BLOCK = 4096
SCORED_AT_ONCE = 512  # anchors of a block that are scored at a time
NEVER = np.iinfo(np.int64).min  # no score: that of a row which is no partner

# A positive goes before the negatives of its own score, so that its window is open for them.
_KEY = np.dtype([("anchor", ">u8"), ("falling", ">u8"), ("kind", "u1"), ("id", ">u8")])
_POSITIVE, _NEGATIVE = 0, 1
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys whose bytes sort by anchor, falling score, kind and rising id."""
    packed = np.zeros(len(anchor), _KEY)
    packed["anchor"] = anchor
    packed["falling"] = ~(score.view(np.uint64) ^ np.uint64(1 << 63))
    packed["kind"] = kind
    packed["id"] = ids.view(np.uint64) ^ np.uint64(1 << 63)
    whole = pa.py_buffer(packed.tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(packed), [None, whole]).cast(pa.binary())


def _best(rows: np.ndarray, columns: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of the (row, column, score) are among their row's first ``k`` by falling score and rising id, in that order."""
    order = np.lexsort((ids[columns], ~score, rows))
    at = np.searchsorted(rows[order], rows[order])
    return order[np.arange(len(order)) - at < k]


def _positives(k: int, anchor_block: int, schema: pa.Schema) -> Callable[[dict, dict], pa.Table]:
    """The block's first ``k`` rows of each anchor's own label."""

    def find(anchors: dict, candidates: dict) -> pa.Table:
        left, right = vectors.vectors_of(anchors), vectors.vectors_of(candidates)
        own, other = vectors.ids_of(anchors), vectors.ids_of(candidates)
        kinds, of = vectors.labels_of(anchors), vectors.labels_of(candidates)
        out = []
        for label in np.intersect1d(kinds, of):  # blocks are ordered by label
            (a, b), (c, d) = ([np.searchsorted(side, label, way) for way in ("left", "right")] for side in (kinds, of))
            for at in range(a, b, SCORED_AT_ONCE):
                some = slice(at, min(b, at + SCORED_AT_ONCE))
                score = vectors.products(left[some], right[c:d])
                score[own[some, None] == other[None, c:d]] = NEVER
                least = np.partition(score, -k, axis=1)[:, -k] if d - c > k else np.full(len(score), NEVER)
                rows, columns = np.nonzero((score >= least[:, None]) & (score != NEVER))
                first = _best(rows, columns, score[rows, columns], other[c:d], k)
                rows, columns = rows[first], columns[first]
                out.append((rows + at, own[rows + at], other[c:d][columns], score[rows, columns]))
        if not out:
            return schema.empty_table()
        rows, names, partners, score = (np.concatenate(one) for one in zip(*out))
        return pa.table(
            [pa.array(one) for one in (anchors["at"] * anchor_block + rows, names, partners, score)], schema=schema
        )

    return find


def _negatives(k: int, anchor_block: int, schema: pa.Schema) -> Callable[[dict, dict], pa.Table]:
    """Keys of the block's rows of other labels that are among the first ``k`` of one of the anchor's windows."""

    def find(anchors: dict, candidates: dict) -> pa.Table:
        left, right = vectors.vectors_of(anchors), vectors.vectors_of(candidates)
        own, other = vectors.ids_of(anchors), vectors.ids_of(candidates)
        kinds, of = vectors.labels_of(anchors), vectors.labels_of(candidates)
        told = anchors["windows"] or []
        place = np.array([w["anchor"] for w in told], np.int64) - anchors["at"] * anchor_block
        window = np.array([w["rank"] for w in told], np.int64) - 1
        shape = (anchors["size"], int(window.max(initial=-1)) + 1)
        low, high = np.ones(shape, np.int64), np.zeros(shape, np.int64)  # without a positive a window is empty
        low[place, window] = [w["low"] for w in told]
        high[place, window] = [w["high"] for w in told]
        out = []
        for at in range(0, anchors["size"] if shape[1] else 0, SCORED_AT_ONCE):
            some = slice(at, at + SCORED_AT_ONCE)
            score = vectors.products(left[some], right)
            real = low[some] <= high[some]
            least = np.where(real, low[some], np.iinfo(np.int64).max).min(axis=1)
            most = np.where(real, high[some], NEVER).max(axis=1)
            wanted = (score >= least[:, None]) & (score <= most[:, None])
            wanted &= (kinds[some, None] != of[None, :]) & (own[some, None] != other[None, :])
            rows, columns = np.nonzero(wanted)
            found = score[rows, columns]
            keep = np.zeros(len(rows), bool)
            for w in range(shape[1]):
                inside = np.flatnonzero((found >= low[some][rows, w]) & (found <= high[some][rows, w]))
                keep[inside[_best(rows[inside], columns[inside], found[inside], other, k)]] = True
            rows, columns, found = rows[keep], columns[keep], found[keep]
            out.append((rows + at, found, other[columns], own[rows + at]))
        if not out:
            return schema.empty_table()
        rows, found, partners, names = (np.concatenate(one) for one in zip(*out))
        keys = _keys(anchors["at"] * anchor_block + rows, found, _NEGATIVE, partners)
        return pa.table([keys, pa.array(names)], schema=schema)

    return find


def _each_pair(
    function: Callable, anchors: DataFrame, candidates: DataFrame, parts: int, count: int, schema: str, arrow: pa.Schema
) -> DataFrame:
    """``function(anchor block, candidate block)`` for each pair of blocks whose vectors have one length."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [function(a, c) for a in left.to_pylist() for c in right.to_pylist() if a["dim"] == c["dim"]]
        return pa.concat_tables(out) if out else arrow.empty_table()

    left, right = vectors.dealt(anchors, candidates, parts, count)
    return left.groupBy("at", "part").cogroup(right.groupBy("at", "part")).applyInArrow(both, schema)


def _windows(low: int, high: int, negatives: int) -> Callable[[Iterator], Iterator[tuple]]:
    """Reads keys in their order; each positive opens a window, each negative falls into those that hold its score."""

    def emit(keys: Iterator[tuple[bytes, int]]) -> Iterator[tuple]:
        anchor, open_ones = None, []
        for key, name in keys:
            which, falling, kind, other = np.frombuffer(key, _KEY)[0].item()
            score, other = 2**63 - 1 - falling, other - 2**63
            if which != anchor:
                anchor, open_ones = which, []
            if kind == _POSITIVE:
                open_ones.append([score, other, 0])
                continue
            for window in open_ones:
                best, positive, taken = window
                if low * best <= 100 * score <= high * best:
                    window[2] = taken + 1
                    yield name, positive, taken + 1, other, best, score
            open_ones = [w for w in open_ones if w[2] < negatives and low * w[0] <= 100 * score]

    return emit


def hard_negatives(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    anchor_block: int = ANCHOR_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """Of each anchor and positive the first ``negatives`` rows of other labels in the positive's window.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. A component x counts as floor(256 * x), the score is the
    inner product, higher scores come first and ties go to the smaller id. The
    positives are the anchor's first ``positives`` other rows of its label; a
    window holds the scores s with low * p <= 100 * s <= high * p for a positive's
    score p, so that a positive below 0 has none. Labels are whole numbers.

    Rows with a null id, label or vector, or a null or non-finite component take
    no part; vectors of different lengths do not meet; a row with the anchor's
    own id is no partner of it. Rows that repeat count each for itself, as
    anchors, positives and negatives. No anchors, no results. Scores are exact in
    64 bits; vectors whose score may pass that are an error.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("a window lies at or below its positive: 0 <= low <= high <= 100")
    spark = rows.sparkSession
    named = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"),
        is_anchor.alias("asks"),
    )
    asking = named.where("asks").select("id", "label", "vector")
    wanted = max(1, -(-asking.count() // anchor_block))
    candidates = vectors.blocks(named.select("id", "label", "vector"), candidate_block, "candidate-blocks")
    asked = vectors.blocks(asking.repartition(wanted, F.xxhash64("id")), anchor_block, "anchor-blocks")
    anchors = vectors.numbered(asked, "numbered-blocks")
    count, parts = max(1, anchors.count()), max(1, candidates.count())

    pair = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    near = _each_pair(
        _positives(positives, anchor_block, pair), anchors, candidates, parts, count,
        "anchor long, anchor_id long, id long, score long", pair,
    )
    falling = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    best = stored(near.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= positives), "positives")

    hundredth = lambda percent: F.col("score").cast("decimal(38,0)") * percent / 100
    spans = best.where("score >= 0").select(
        F.floor(F.col("anchor") / anchor_block).cast("int").alias("at"),
        F.struct(
            "anchor", "rank", F.ceil(hundredth(low)).cast("long").alias("low"),
            F.floor(hundredth(high)).cast("long").alias("high"),
        ).alias("window"),
    )
    told = anchors.join(spans.groupBy("at").agg(F.collect_list("window").alias("windows")), "at", "left")
    packed = pa.schema([("key", pa.binary()), ("anchor_id", pa.int64())])
    below = _each_pair(
        _negatives(negatives, anchor_block, packed), told, candidates, parts, count, "key binary, anchor_id long", packed
    )

    def openers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, score, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "score", "id"))
            yield pa.RecordBatch.from_arrays([_keys(anchor, score, _POSITIVE, ids), batch.column("anchor_id")], schema=packed)

    opening = best.select("anchor", "score", "id", "anchor_id").mapInArrow(openers, "key binary, anchor_id long")
    sorted_keys = (
        below.unionByName(opening).rdd.map(lambda row: (bytes(row[0]), row[1]))
        .repartitionAndSortWithinPartitions(
            int(spark.conf.get("spark.sql.shuffle.partitions")), lambda k: int.from_bytes(k[:8], "big")
        )
    )
    return spark.createDataFrame(sorted_keys.mapPartitions(_windows(low, high, negatives)), _MINED, verifySchema=False)
