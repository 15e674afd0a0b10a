"""Exact top-k by inner product, found by distributed histograms of the scores.

Vectors become whole numbers, so every score is exact. Queries and candidates
are cut into blocks and each pair of blocks is scored in one task. Pass by pass
the tasks report how many scores of each query share the next digits of its kth
score, and the sums fix these digits; after the last pass every query's kth
score and the number of ties to take are known. One more pass returns the
scores above it and the ties with the least ids.
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

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096
SCORED_AT_ONCE = 512  # queries of a block that are scored at a time
DIGIT_BITS = 12

def _scores(queries: dict, candidates: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First query, whole scores and ids of a few queries at a time; a query's own id scores the least number."""
    left, right = vectors.vectors_of(queries), vectors.vectors_of(candidates)
    own, other = vectors.ids_of(queries), vectors.ids_of(candidates)
    kind = vectors.exact_kind(left, right)
    turned = np.ascontiguousarray(right.T.astype(kind))
    for at in range(0, queries["size"], SCORED_AT_ONCE):
        found = (left[at:at + SCORED_AT_ONCE].astype(kind) @ turned).astype(np.int64)
        found[own[at:at + SCORED_AT_ONCE, None] == other[None, :]] = np.iinfo(np.int64).min
        yield at, found, other


def _pairs(function: Callable, queries: DataFrame, candidates: DataFrame, parts: int, blocks: int, schema: str) -> DataFrame:
    """``function(query block, candidate block)`` for every pair of a query block and a candidate block.

    Both sides are dealt to (query block, part of the candidates), so that a task
    holds one query block and about one candidate block at a time.
    """

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [function(q, c) for q in left.to_pylist() for c in right.to_pylist() if q["dim"] == c["dim"]]
        return pa.concat_tables(out) if out else empty

    empty = pa.Table.from_batches([], schema=_arrow_schema(schema))
    left, right = vectors.dealt(queries, candidates, parts, blocks)
    return left.groupBy("at", "part").cogroup(right.groupBy("at", "part")).applyInArrow(both, schema)


def _arrow_schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in text.split(", "))])


def _state(queries: dict) -> tuple[np.ndarray, np.ndarray]:
    """The known leading digits of each query's kth score and the rank sought among the scores that share them."""
    prefix, need = np.zeros(queries["size"], np.int64), np.zeros(queries["size"], np.int64)
    for one in queries["state"] or ():
        prefix[one["query"]], need[one["query"]] = one["prefix"], one["need"]
    return prefix, need


def _histogram(offset: int, above: int, shift: int):
    """Counts of the next digits: scores that share the digits above bit ``above``, by the bits from ``shift``."""
    width = 1 << (above - shift)

    def count(queries: dict, candidates: dict) -> pa.Table:
        prefix, need = _state(queries)
        out = [np.zeros((0, 3), np.int64)]
        for at, found, _ in _scores(queries, candidates):
            some = slice(at, at + len(found))
            real = found != np.iinfo(np.int64).min
            lifted = np.where(real, found + offset, 0)
            real &= (lifted >> above) == prefix[some, None]
            row, _ = np.nonzero(real)
            digit = (lifted[real] >> shift) & (width - 1)
            seen, n = np.unique(row * width + (width - 1 - digit), return_counts=True)
            row, digit = seen // width, width - 1 - seen % width
            # From the highest digit down to the first at which this block alone reaches the rank sought.
            total = np.cumsum(n)
            first = np.searchsorted(row, row)
            before = total - n - np.where(first > 0, total[first - 1], 0)
            wanted = before < need[some][row]
            out.append(np.column_stack([row[wanted] + at, digit[wanted], n[wanted]]))
        rows = np.vstack(out)
        return pa.table(
            [pa.array(np.full(len(rows), queries["at"], np.int32)), *(pa.array(rows[:, i]) for i in range(3))],
            names=["at", "query", "digit", "n"],
        )

    return count


def _above(offset: int):
    """The scores above each query's kth, and of those equal to it the least ids, as many as are sought."""

    def take(queries: dict, candidates: dict) -> pa.Table:
        prefix, need = _state(queries)
        names = vectors.ids_of(queries)
        out = [np.zeros((0, 4), np.int64)]
        for at, found, ids in _scores(queries, candidates):
            some = slice(at, at + len(found))
            kth = np.where(need[some] > 0, prefix[some] - offset, np.iinfo(np.int64).max)
            order = np.argsort(ids, kind="stable")
            ties = found[:, order] == kth[:, None]
            ties &= np.cumsum(ties, axis=1) <= need[some, None]
            for row, place in (np.nonzero(found > kth[:, None]), _through(np.nonzero(ties), order)):
                out.append(np.column_stack([row + at, names[row + at], ids[place], found[row, place]]))
        rows = np.vstack(out)
        return pa.table(
            [pa.array(np.full(len(rows), queries["at"], np.int32)), *(pa.array(rows[:, i]) for i in range(4))],
            names=["at", "query", "query_id", "vec_id", "score"],
        )

    return take


def _through(found: tuple[np.ndarray, np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return found[0], order[found[1]]


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, digit_bits: int = DIGIT_BITS,
) -> DataFrame:
    """For each query row the ``k`` best other rows: ``query_id, rank, vec_id, score``.

    A component x counts as floor(256 * x); the score is the inner product.
    Ranks start at 1 and ties go to the smaller id. A query's own id is no
    candidate for it. Rows with a null id, a null vector, or a null or non-finite
    component take no part, and vectors of different lengths do not meet. A
    query row that repeats is answered each time; a query with fewer
    candidates gets all. No rows, no answers. Scores are exact in 64 bits; vectors
    so long that a score may pass 2**62 are an error.
    """
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    asking = named.where("asks").select("id", "vector")
    blocks = max(1, -(-asking.count() // query_block))
    candidates = vectors.blocks(named.select("id", "vector"), candidate_block, "candidate-blocks")
    asked = vectors.blocks(asking.repartition(blocks, F.xxhash64("id")), query_block, "query-blocks")
    queries = vectors.numbered(asked, "numbered-blocks")
    blocks = max(1, queries.count())
    sizes = candidates.agg(F.count("*").alias("n"), F.max("longest").alias("longest")).first()
    parts = max(1, sizes["n"])
    reach = float(np.sqrt((sizes["longest"] or 0.0) * (queries.agg(F.max("longest")).first()[0] or 0.0)))
    if reach >= 2.0**62:
        raise ValueError("scores may not fit 62 bits")
    bits = int(reach * (1 + 1e-9) + 1).bit_length() + 1
    offset = 1 << (bits - 1)
    state = queries.select("at", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("query")).select(
        "at", F.col("query").cast("long"), F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need")
    )

    def told(state: DataFrame) -> DataFrame:
        grouped = state.groupBy("at").agg(F.collect_list(F.struct("query", "prefix", "need")).alias("state"))
        return queries.join(grouped, "at", "left")

    above = bits
    while above > 0:
        shift = max(0, above - digit_bits)
        counts = (
            _pairs(_histogram(offset, above, shift), told(state), candidates, parts, blocks,
                   "at int, query long, digit long, n long")
            .groupBy("at", "query", "digit").agg(F.sum("n").alias("n"))
        )
        down = Window.partitionBy("at", "query").orderBy(F.col("digit").desc())
        summed = counts.withColumn("upto", F.sum("n").over(down)).join(state, ["at", "query"])
        # Where all candidates are fewer than sought, the last of them is the kth.
        total = F.max("upto").over(Window.partitionBy("at", "query"))
        sought = F.least("need", total)
        state = stored(
            summed.withColumn("need", sought)
            .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            .select(
                "at", "query",
                (F.shiftleft("prefix", above - shift) + F.col("digit")).alias("prefix"),
                (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"),
            ),
            "kth-scores",
        )
        above = shift
    found = _pairs(_above(offset), told(state), candidates, parts, blocks,
                   "at int, query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("at", "query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
