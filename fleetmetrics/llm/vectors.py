"""Blocks of whole-number vectors, and exact scores between two blocks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
BLOCK = "block long, size int, dim int, longest double, ids binary, labels binary, vectors binary"


def _narrowest(whole: np.ndarray) -> type:
    most = np.abs(whole).max(initial=0)
    return np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64


def _packer(block: int, labelled: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of id, label and vector to blocks of vectors of one length, as whole numbers, by label."""

    def ready(ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        whole = np.vstack(vectors)
        longest = float(np.square(whole).sum(axis=1).max(initial=0))
        if np.abs(whole).max(initial=0) >= 2.0**62:
            raise ValueError("a scaled component does not fit 62 bits")
        names, groups = np.array(ids, np.int64), np.array(labels, np.int64)
        order = np.lexsort((names, groups))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(ids)], pa.int32()), pa.array([whole.shape[1]], pa.int32()), pa.array([longest]),
                pa.array([names[order].tobytes()]), pa.array([groups[order].tobytes()]),
                pa.array([whole[order].astype(_narrowest(whole)).tobytes()]),
            ],
            ["size", "dim", "longest", "ids", "labels", "vectors"],
        )

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list, list]] = {}
        for batch in rows:
            column = batch.column("vector")
            labels = batch.column("label").to_pylist() if labelled else [0] * batch.num_rows
            lengths = column.value_lengths().to_pylist()
            for row, (name, label, length) in enumerate(zip(batch.column("id").to_pylist(), labels, lengths)):
                if name is None or label is None or length is None:
                    continue
                values = column[row].values
                if values.null_count:
                    continue
                vector = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(vector).all():
                    continue
                with np.errstate(over="ignore"):
                    scaled = np.floor(vector * SCALE)
                held = waiting.setdefault(length, ([], [], []))
                for one, value in zip(held, (name, label, scaled), strict=True):
                    one.append(value)
                if len(held[0]) == block:
                    yield ready(*waiting.pop(length))
        for held in waiting.values():
            yield ready(*held)

    return pack


def blocks(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Rows ``id, vector`` and perhaps ``label`` as stored blocks of at most ``block`` vectors of one length.

    A component x counts as floor(256 * x). Rows with a null id or label, a null
    vector, or a null or non-finite component are left out. In a block rows are
    ordered by label and id. ``block`` names it.
    """
    labelled = "label" in rows.columns
    packed = rows.mapInArrow(_packer(block, labelled), BLOCK.replace("block long, ", ""))
    return stored(packed.select(F.monotonically_increasing_id().alias("block"), "*"), name)


def numbered(found: DataFrame, name: str) -> DataFrame:
    """The blocks with ``at``, their number from 0: only names of blocks are put in order, no vectors are moved for it.

    A block's name is its partition's number and its place there, so the
    partitions' first numbers, few and small, give all the others.
    """
    part = F.shiftrightunsigned("block", 33)
    within = F.col("block").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in found.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    first, seen = [], 0
    for p in sorted(sizes):
        first.append((p, seen))
        seen += sizes[p]
    starts = found.sparkSession.createDataFrame(first, "p long, first long")
    placed = found.withColumn("p", part).join(F.broadcast(starts), "p").drop("p")  # a row per partition of queries
    return stored(placed.withColumn("at", (F.col("first") + within).cast("int")).drop("first"), name)


def dealt(queries: DataFrame, candidates: DataFrame, parts: int, count: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by (query block, part of the candidates): a task holds one query block and about one other at a time."""
    left = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = candidates.withColumn("part", part_of(F.col("block"), parts)).withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    )
    return left, right


def part_of(block: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(block), F.lit(parts)).cast("int")


def ids_of(block: dict) -> np.ndarray:
    return np.frombuffer(block["ids"], np.int64)


def labels_of(block: dict) -> np.ndarray:
    return np.frombuffer(block["labels"], np.int64)


def vectors_of(block: dict) -> np.ndarray:
    cells = block["size"] * block["dim"]
    width = len(block["vectors"]) // cells if cells else 8
    return np.frombuffer(block["vectors"], f"i{width}").reshape(block["size"], block["dim"])


def exact_kind(left: np.ndarray, right: np.ndarray) -> type:
    """The fastest number type in which inner products of the two sides are exact whole numbers."""
    if not left.size or not right.size:
        return np.int64
    # As Python's numbers, which do not overflow; no partial sum can pass this.
    most = [max(int(side.max()), -int(side.min())) for side in (left, right)]
    largest = most[0] * most[1] * left.shape[1]
    if largest < 2**24:
        return np.float32
    if largest < 2**53:
        return np.float64
    if largest >= 2**63:
        raise ValueError("scores may not fit 64 bits")
    return np.int64


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of the two sides, as exact 64-bit numbers."""
    kind = exact_kind(left, right)
    return (left.astype(kind) @ right.T.astype(kind)).astype(np.int64)
