"""Near copies by MinHash with odd sketches.

A document's set holds its distinct shingles of words. MinHash samples of the set
make bands, whose equal values bring documents together, and an odd sketch: a
bitmap in which every sample flips one bit. The bits in which two sketches differ
tell how many samples do, closely so where the similarity is high, and only
documents that can still be similar enough stay together. What stays is compared
on the full sets.

Each step keeps links rather than pairs: of the pairs in a bucket or group it
reports as many as join what belongs together, fewer than there are members.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .components import components
from .tables import spread_join, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


MISSED = 1e-6


@dataclass(frozen=True)
class NearCopies:
    """What counts as a near copy, and how candidates are found.

    There are as many bands as let them miss a pair at the threshold with a chance
    of MISSED at most, 24 of 5 samples with similarity 0.85, 35 with 0.80; a pair at
    the threshold passes the sketch test by more than 5 standard deviations.
    """

    words: int = 5
    percent: int = 80  # intersection of at least this share of the union
    bands: int = 0  # 0 for those that the threshold needs
    rows: int = 5
    samples: int = 240  # or bands * rows, if more: all go into the sketch, bands * rows of them into bands
    sketch_bits: int = 1024
    seed: int = 11
    bucket_block: int = 2048  # sketches of a bucket compared in one task, against as many
    set_block: int = 150_000  # shingles of a group compared in one task, against as many

    def __post_init__(self) -> None:
        if not self.bands:
            passed = (self.percent / 100) ** self.rows
            needed = 1 if passed >= 1 else math.ceil(math.log(MISSED) / math.log1p(-passed))
            object.__setattr__(self, "bands", needed)
        object.__setattr__(self, "samples", max(self.samples, self.bands * self.rows))

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 2**32, self.samples, np.uint32) | np.uint32(1)

    def most_differing_bits(self) -> int:
        """Bits in which two sketches may differ while the sets may be similar enough."""
        j, k, n = self.percent / 100, self.samples, self.sketch_bits
        differing = k * (1 - j) + 5.5 * math.sqrt(k * j * (1 - j))
        mean = n / 2 * (1 - (1 - 2 / n) ** (2 * differing))
        return math.ceil(mean + 2 * math.sqrt(mean))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words is one shingle, one without words none."""
    powers = arrays.Powers(arrays.BASES[0])
    for at, end, body, bounds in arrays.chunks(column):
        lowered = arrays.LOWER[body]
        starts, ends, owner = arrays.words(lowered, bounds)
        hashes = arrays.span_hashes(arrays.prefix_sums(lowered, powers), starts, ends, powers)
        total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for back in range(words):
            total = total * np.uint64(arrays.BASES[1]) + hashes[back:back + len(total)]
        total = arrays.mix(total)
        cuts = np.searchsorted(owner, np.arange(end - at + 1))
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if last - first >= words:
                own = np.sort(total[first:last - words + 1])
                yield own[arrays.first_of_runs(own)]
            elif last > first:
                few = np.array([last - first], np.uint64)
                for place in range(first, last):
                    few = few * np.uint64(arrays.BASES[1]) + hashes[place]
                yield arrays.mix(few)
            else:
                yield np.zeros(0, np.uint64)


def _signature(own: np.ndarray, how: NearCopies, multipliers: np.ndarray) -> np.ndarray:
    """MinHash samples: for each multiplier the least product of a shingle."""
    least = np.full(how.samples, np.uint32(0xFFFFFFFF))
    short = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(least, (short[at:at + 4096, None] * multipliers).min(axis=0), out=least)
    return least


def _describer(how: NearCopies) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def describe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = how.multipliers()
        numbered = np.arange(how.samples, dtype=np.uint64) << np.uint64(32)
        fold = np.array([pow(arrays.BASES[1], i + 1, 1 << 64) for i in range(how.rows)], np.uint64)
        for batch in rows:
            sizes, digests, bands, sketches = [], [], [], []
            for own in shingle_sets(batch.column("text"), how.words):
                sizes.append(len(own))
                digests.append((
                    int(own.sum(dtype=np.uint64).astype(np.int64)),
                    int(arrays.mix(own ^ np.uint64(arrays.BASES[0])).sum(dtype=np.uint64).astype(np.int64)),
                ))
                if not len(own):
                    bands.append([])
                    sketches.append(b"")
                    continue
                tagged = arrays.mix(_signature(own, how, multipliers) | numbered)
                banded = tagged[:how.bands * how.rows].reshape(how.bands, how.rows)
                bands.append(arrays.mix((banded * fold).sum(axis=1, dtype=np.uint64)).astype(np.int64))
                flips = np.bincount((tagged % np.uint64(how.sketch_bits)).astype(np.int64), minlength=how.sketch_bits)
                sketches.append(np.packbits((flips & 1).astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(sizes, pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                ],
                ["id", "n", "d1", "d2", "bands", "sketch"],
            )

    return describe


def _grouped(function: Callable[[pa.Table], tuple[list, list]], keys: list[str]):
    """Row code over rows sorted by the keys: runs of equal keys go to ``function``, which returns links."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = function(pa.Table.from_batches(parts))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        last = None
        for batch in rows:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            cuts = np.flatnonzero(arrays.first_of_runs(*columns)).tolist()
            for first, end in zip(cuts, [*cuts[1:], batch.num_rows]):
                key = tuple(c[first] for c in columns)
                if key != last and held:
                    if sum(p.num_rows for p in held) > 1:
                        yield linked(held)
                    held = []
                held.append(batch.slice(first, end - first))
                last = key
        if sum(p.num_rows for p in held) > 1:
            yield linked(held)

    return run


class _Union:
    """Labels of the members of a group, and the links that joined them."""

    def __init__(self, names: np.ndarray) -> None:
        self.names, self.a, self.b = names, [], []
        _, self.label = np.unique(names, return_inverse=True)

    def join(self, one: int, others: np.ndarray) -> None:
        """Link a member to one of each other class among the others."""
        others = others[self.label[others] != self.label[one]]
        if not len(others):
            return
        labels, first = np.unique(self.label[others], return_index=True)
        self.a += [int(self.names[one])] * len(labels)
        self.b += self.names[others[first]].tolist()
        self.label[np.isin(self.label, labels)] = self.label[one]

    def whole(self) -> bool:
        return bool((self.label == self.label[0]).all())


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are compared with which: those of one block with each other, those of two across."""
    low, high = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    if low == high:
        every = np.arange(rows.num_rows)
        return every, every
    own = rows.column("own").to_numpy()
    return np.flatnonzero(own == low), np.flatnonzero(own == high)


def _similar_sketches(how: NearCopies):
    most, percent = how.most_differing_bits(), how.percent

    def link(rows: pa.Table) -> tuple[list, list]:
        body, _ = arrays.flat(rows.column("sketch"))
        sketches = body.reshape(rows.num_rows, -1).view(np.uint64)
        size = rows.column("n").to_numpy()
        found = _Union(rows.column("node").to_numpy())
        ours, theirs = _sides(rows)
        for row in ours.tolist():
            others = theirs[np.searchsorted(theirs, row, "right"):] if ours is theirs else theirs
            apart = others[found.label[others] != found.label[row]]
            lesser, greater = np.minimum(size[apart], size[row]), np.maximum(size[apart], size[row])
            apart = apart[100 * lesser >= percent * greater]
            if len(apart):
                bits = np.bitwise_count(sketches[apart] ^ sketches[row]).sum(axis=1)
                found.join(row, apart[bits <= most])
        return found.a, found.b

    return link


def _similar_sets(how: NearCopies):
    def link(rows: pa.Table) -> tuple[list, list]:
        sets = list(shingle_sets(rows.column("text"), how.words))
        size = np.array([len(s) for s in sets])
        found = _Union(rows.column("node").to_numpy())
        if len(sets) == 2:
            shared = len(np.intersect1d(*sets, assume_unique=True))
            if 100 * shared >= how.percent * (size.sum() - shared):
                found.join(0, np.array([1]))
            return found.a, found.b
        shingles, number = np.unique(np.concatenate(sets), return_inverse=True)
        member = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(number, kind="stable")
        holders, start = member[order], np.searchsorted(number[order], np.arange(len(shingles) + 1))
        begins = np.concatenate([[0], np.cumsum(size)])
        ours, theirs = _sides(rows)
        compared = np.zeros(len(sets), bool)
        compared[theirs] = True
        for row in ours.tolist():
            own = number[begins[row]:begins[row + 1]]
            shared = np.bincount(
                holders[arrays.ragged(start[own], start[own + 1] - start[own])], minlength=len(sets)
            )
            found.join(row, np.flatnonzero(compared & (100 * shared >= how.percent * (size + size[row] - shared))))
            if found.whole():
                break
        return found.a, found.b

    return link


def _dealt(rows: DataFrame, group: str, blocks: str, keys: list[str]) -> DataFrame:
    """Rows of each group in pairs of blocks: a group of one block once, of more in every pair of its blocks.

    The work of a pair is far more than its bytes tell, so there are as many tasks
    as shuffles have, which adaptive execution leaves alone.
    """
    own = F.pmod(F.xxhash64("node"), F.col(blocks))
    every = F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)
    lone = F.when(F.col(blocks) > 1, every).otherwise(F.array(own))
    paired = rows.withColumn("own", own).withColumn("other", F.explode(lone)).select(
        "*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    ).drop("other", blocks)
    assert keys == [group, "lo", "hi"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paired.repartition(tasks, *keys).sortWithinPartitions(*keys)


def near_copies(
    docs: DataFrame, how: NearCopies = NearCopies(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each document's class of near copies: ``key, n_shingles, component_id, kept``.

    Documents are linked if their shingle sets share enough of their union;
    ``component_id`` is the least key that links reach, ``kept`` whether it is the
    document's own. Words are runs of other than ASCII white space with A-Z in
    lower case; a text with fewer words than a shingle is one shingle. A null or
    empty text, and one of white space, has no shingles and no links.

    Keys are whole numbers. Rows that repeat a key are one document, whose links
    are those of all its texts. Rows with a null key have no links, a null
    component, and are kept. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    described = stored(
        rows.mapInArrow(
            _describer(how), "id long, n long, d1 long, d2 long, bands array<long>, sketch binary"
        ),
        "shingle-sets",
    )
    linkable = described.where((F.col("n") > 0) & F.col("id").isNotNull())
    # Equal sets are one node, named by its least key.
    nodes = stored(
        linkable.groupBy("d1", "d2").agg(
            F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        ),
        "set-nodes",
    )
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = placed.join(
        shared.select("bucket", F.ceil(F.col("members") / how.bucket_block).cast("long").alias("blocks")), "bucket"
    ).join(nodes.select("node", "n", "sketch"), "node")
    keys = ["bucket", "lo", "hi"]
    close = _dealt(met, "bucket", "blocks", keys).mapInArrow(
        _grouped(_similar_sketches(how), keys), "a long, b long"
    )
    groups = stored(components(close).withColumnRenamed("component", "group"), "candidate-groups")
    sizes = groups.join(nodes.select("node", "n"), "node").groupBy("group").agg(
        F.ceil(F.sum("n") / how.set_block).cast("long").alias("blocks")
    )
    texts = rows.withColumnRenamed("id", "node").join(groups.join(sizes, "group"), "node")
    keys = ["group", "lo", "hi"]
    links = _dealt(texts, "group", "blocks", keys).mapInArrow(
        _grouped(_similar_sets(how), keys), "a long, b long"
    )
    classes = components(links)
    named = nodes.select("d1", "d2", "node").join(classes, "node", "left").select(
        "d1", "d2", F.coalesce("component", "node").alias("component")
    )
    # Copies of one text may be a third of all rows.
    own = spread_join(described.select("id", "n", "d1", "d2"), named, ["d1", "d2"], "id", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    )
    return own.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
