"""Removal of every byte run that a long string found elsewhere covers.

Strings of ``length`` bytes are dealt by an anchor: of the n-grams of ``gram``
bytes inside a string, the one with the least hash. Equal strings have equal
anchors, so an anchor found once has no repeats and its text goes no further. The
strings of one anchor stand next to each other in a document; they and the bytes
they need make a piece, and anchor and digest, 128 bits, name it. Equal pieces are
counted first and enter once with their number. Pieces are put into shards by their anchor; each shard's suffix array and
common prefixes tell which of its strings occur twice or more. The pieces of an
anchor too frequent for one shard fill several, whose sorted strings are merged
by binary search.
"""

from __future__ import annotations

import hashlib
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
from .suffix_arrays import common_prefixes, suffix_array
from .tables import stored, text_key, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLACE_BITS = 28  # a text may have up to 2**28 bytes


@dataclass(frozen=True)
class Repeats:
    """Length of the strings, of the n-grams that anchor them, and bytes of a shard."""

    length: int = 200
    gram: int = 48
    shard_bytes: int = 600_000


def _least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by running minima of blocks from both ends."""
    n = len(key) - width + 1
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(key)] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _pieces(body: np.ndarray, bounds: np.ndarray, how: Repeats, powers: tuple[arrays.Powers, arrays.Powers]):
    """Row, start, number of strings, anchor, digest and times of each piece of a chunk.

    A piece that follows itself, as in text with a short period, is told once,
    with how many times it comes; each time begins where the strings of the one
    before end.
    """
    sizes = np.maximum(np.diff(bounds) - how.length + 1, 0)
    starts = arrays.ragged(bounds[:-1], sizes)
    if not len(starts):
        return None
    if len(body) >= 1 << PLACE_BITS:
        raise ValueError(f"a text of more than {1 << PLACE_BITS} bytes")
    sums = [arrays.prefix_sums(body, p) for p in powers]
    grams = np.arange(len(body) - how.gram + 1)
    hashes = arrays.span_hashes(sums[0], grams, grams + how.gram, powers[0])
    # Equal hashes go to the first: the place in the low bits decides, in every copy alike.
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = _least_in_windows((hashes & ~low) | grams.astype(np.uint64), how.length - how.gram + 1)
    anchor = (least[starts] & low).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cuts = np.flatnonzero(arrays.first_of_runs(anchor, owner))
    many = np.diff(np.append(cuts, len(starts)))
    first = starts[cuts]
    ends = first + many + how.length - 1
    digest = arrays.span_hashes(sums[1], first, ends, powers[1])
    row, gram = owner[cuts], hashes[anchor[cuts]]
    once = np.flatnonzero(arrays.first_of_runs(row, gram, digest, many))
    times = np.diff(np.append(once, len(row)))
    return row[once], (first - bounds[row])[once], many[once], gram[once], digest[once], times


_PIECE = "g long, r long, k1 long, k2 long, at long, many int, times int"


def _cutter(how: Repeats, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to their pieces, or to the pieces' anchors alone."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = arrays.Powers(arrays.BASES[0]), arrays.Powers(arrays.BASES[1])
        for batch in rows:
            for at, end, body, bounds in arrays.chunks(batch.column("text")):
                found = _pieces(body, bounds, how, powers)
                if found is None:
                    continue
                row, first, many, anchor, digest, times = found
                hashes = [pa.array(x.astype(np.int64)) for x in (anchor, digest)]
                counts = [pa.array(x.astype(np.int32)) for x in (many, times)]
                if not whole:
                    yield pa.RecordBatch.from_arrays([hashes[0], counts[1]], ["g", "times"])
                    continue
                keys = [batch.column(k).slice(at, end - at).take(pa.array(row)) for k in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays(
                    [*hashes, *keys, pa.array(first), *counts], ["g", "r", "k1", "k2", "at", "many", "times"]
                )

    return cut


def _copy_pieces(how: Repeats):
    """Texts, each with the pieces it stands for, to the bytes of these pieces; equal texts in a row count once."""

    def copy(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in rows:
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            for row in range(batch.num_rows):
                if keys[row] == last:
                    continue
                last = keys[row]
                told = batch.column("told")[row].values
                if told is None or not len(told):
                    continue
                text = (batch.column("text")[row].as_py() or "").encode()
                at, many = (told.field(n).to_numpy() for n in ("at", "many"))
                bodies = [text[a:a + m + how.length - 1] for a, m in zip(at.tolist(), many.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(told.field(n) for n in ("shard", "part", "g", "r", "weight", "many")),
                     pa.array(bodies, pa.binary())],
                    ["shard", "part", "g", "r", "weight", "many", "body"],
                )

    return copy


_SHARD_ROW = "shard long, part int, g long, r long, weight long, many int, body binary"


def _classes(shard: pa.Table, how: Repeats):
    """Of a shard's strings in suffix order: place, class, and each class's number of occurrences."""
    body, bounds = arrays.flat(shard.column("body"))
    order = suffix_array(body, bounds)
    shared = common_prefixes(body, bounds, order)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    string = bounds[1:][owner[order]] - order >= how.length
    # Between two strings of a class all suffixes share as much, so only strings stand there.
    label = np.cumsum(shared < how.length)
    order, label = order[string], label[string]
    _, label = np.unique(label, return_inverse=True)
    weight = np.bincount(label, weights=shard.column("weight").to_numpy()[owner[order]]).astype(np.int64)
    return body, bounds, owner, order, label, weight


def _runs(shard: pa.Table, bounds: np.ndarray, owner: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring strings of each piece, from the places of strings: g, r, first, last."""
    places = np.sort(places)
    starts = arrays.first_of_runs(owner[places], places - np.arange(len(places)))
    firsts = np.flatnonzero(starts)
    lasts = np.append(firsts[1:], len(places)) - 1
    piece = owner[places[firsts]]
    return pa.RecordBatch.from_arrays(
        [*(shard.column(n).combine_chunks().take(pa.array(piece)) for n in ("g", "r")),
         pa.array(places[firsts] - bounds[piece]), pa.array(places[lasts] - bounds[piece])],
        ["g", "r", "first", "last"],
    )


_RUN = "g long, r long, first long, last long"


def _by_shard(function: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """Rows sorted by shard and part to tables of one shard, each piece once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def whole() -> Iterator[pa.RecordBatch]:
            shard = pa.Table.from_batches(held)
            # Copies of a text in several tasks may have sent a piece more than once.
            names = [shard.column(n).to_numpy() for n in ("g", "r")]
            order = np.lexsort(names)
            once = order[arrays.first_of_runs(*(n[order] for n in names))]
            yield from function(shard if len(once) == len(order) else shard.take(pa.array(np.sort(once))))

        for batch in rows:
            if not batch.num_rows:
                continue
            keys = [batch.column(n).to_numpy() for n in ("shard", "part")]
            cuts = np.flatnonzero(arrays.first_of_runs(*keys)).tolist()
            for first, end in zip(cuts, [*cuts[1:], batch.num_rows]):
                key = (keys[0][first], keys[1][first])
                if key != last and held:
                    yield from whole()
                    held = []
                held.append(batch.slice(first, end - first))
                last = key
        if held:
            yield from whole()

    return run


def _repeated_in_shard(how: Repeats):
    def find(shard: pa.Table) -> Iterator[pa.RecordBatch]:
        _, bounds, owner, order, label, weight = _classes(shard, how)
        yield _runs(shard, bounds, owner, order[weight[label] > 1])

    return find


_SORTED = "g long, merge long, shard_part int, strings binary, weights binary, r binary, places binary"


def _sorted_strings(how: Repeats, merges: int):
    """A shard's distinct strings in order, cut by a hash of the string into ``merges`` sorted runs."""

    def cut(shard: pa.Table) -> Iterator[pa.RecordBatch]:
        body, bounds, owner, order, label, weight = _classes(shard, how)
        first = np.flatnonzero(arrays.first_of_runs(label))
        places = order[first]
        powers = arrays.Powers(arrays.BASES[0])
        hashes = arrays.span_hashes(arrays.prefix_sums(body, powers), places, places + how.length, powers)
        merge = (hashes % np.uint64(merges)).astype(np.int64)
        names = [shard.column(n).to_numpy() for n in ("g", "r")]
        for one in np.unique(merge):
            own = merge == one
            at, piece = places[own], owner[places[own]]
            for g in np.unique(names[0][piece]):
                some = names[0][piece] == g
                strings = body[at[some, None] + np.arange(how.length)[None, :]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g]), pa.array([one]), pa.array([shard.column("part")[0].as_py()], pa.int32()),
                        pa.array([strings.tobytes()], pa.binary()),
                        *(pa.array([x[some].astype(np.int64).tobytes()], pa.binary())
                          for x in (weight[own], names[1][piece], at - bounds[piece])),
                    ],
                    [field.split()[0] for field in _SORTED.split(", ")],
                )

    return cut


def _merge_shards(how: Repeats):
    """Sorted runs of strings from several shards: each run is searched for in all of them together."""

    def merge(runs: pa.Table) -> pa.Table:
        rows = runs.to_pylist()
        strings = [np.frombuffer(r["strings"], f"V{how.length}").view(f"S{how.length}") for r in rows]
        numbers = {n: [np.frombuffer(r[n], np.int64) for r in rows] for n in ("weights", "r", "places")}
        joined = np.concatenate(strings)
        order = np.argsort(joined, kind="stable")  # merges the sorted runs
        merged = joined[order]
        total = np.concatenate([[0], np.cumsum(np.concatenate(numbers["weights"])[order])])
        out = [[], [], []]
        for nth, run in enumerate(strings):
            from_, to = np.searchsorted(merged, run, "left"), np.searchsorted(merged, run, "right")
            # Strings that their own shard holds twice are known; here count those with others elsewhere.
            found = (total[to] - total[from_] > 1) & (numbers["weights"][nth] == 1)
            for column, name in zip(out, ("r", "places", "places")):
                column.append(numbers[name][nth][found])
        columns = [np.concatenate(c) for c in out]
        return pa.table(
            [pa.array(np.full(len(columns[0]), rows[0]["g"])), *map(pa.array, columns)],
            names=["g", "r", "first", "last"],
        )

    return merge


def repeated_spans(docs: DataFrame, text: str = "text", how: Repeats = Repeats()) -> tuple[DataFrame, DataFrame]:
    """The texts with their 128-bit keys, and for each key the byte spans to remove.

    The first table has ``text, k1, k2``, a row for each of ``docs``. The second has
    ``k1, k2`` and ``spans``, an array of (start, end) in no order that may overlap;
    texts without repeats are not in it.
    """
    texts = docs.select(text_of(text).alias("text"), *text_key(text_of(text)))
    twice = (
        texts.select("text").mapInArrow(_cutter(how, whole=False), "g long, times int")
        .groupBy("g").agg(F.sum("times").alias("n")).where("n > 1").select("g")
    )
    found = stored(texts.mapInArrow(_cutter(how, whole=True), _PIECE).join(twice, "g", "left_semi"), "pieces")
    # Equal pieces are one, with their number and the place of one of them.
    distinct = stored(
        found.groupBy("g", "r").agg(
            F.sum("times").alias("weight"),
            *(F.first(c).alias(c) for c in ("k1", "k2", "at", "many")),
        ),
        "distinct-pieces",
    )
    size = F.col("many") + F.lit(how.length - 1)
    per_anchor = distinct.groupBy("g").agg(F.sum(size).alias("bytes"))
    total = per_anchor.agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("most")).first()
    shards = max(1, -(-(total["bytes"] or 0) // how.shard_bytes))
    parts = F.ceil(F.col("bytes") / how.shard_bytes).cast("int")
    frequent = per_anchor.where(F.col("bytes") > how.shard_bytes).select("g", parts.alias("parts"))
    placed = distinct.join(frequent, "g", "left").select(
        F.coalesce(F.when(F.col("parts").isNotNull(), F.col("g")), F.pmod(F.xxhash64("g"), F.lit(shards))).alias("shard"),
        F.coalesce(F.pmod("r", F.col("parts")), F.lit(-1)).cast("int").alias("part"),
        "g", "r", "weight", "k1", "k2", "at", "many",
    )
    told = placed.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("shard", "part", "g", "r", "weight", "at", "many")).alias("told")
    )
    rows = (
        texts.join(told, ["k1", "k2"]).select("k1", "k2", "text", "told")
        .mapInArrow(_copy_pieces(how), _SHARD_ROW)
        .repartition("shard", "part").sortWithinPartitions("shard", "part")
    )
    if (total["most"] or 0) > how.shard_bytes:
        rows = stored(rows, "shards").repartition("shard", "part").sortWithinPartitions("shard", "part")
        merges = max(1, -(-total["most"] // how.shard_bytes)) * how.length // 4
        runs = rows.where("part >= 0").mapInArrow(_by_shard(_sorted_strings(how, merges)), _SORTED)
        across = runs.groupBy("g", "merge").applyInArrow(_merge_shards(how), _RUN)
        repeated = rows.mapInArrow(_by_shard(_repeated_in_shard(how)), _RUN).unionByName(across)
    else:
        repeated = rows.mapInArrow(_by_shard(_repeated_in_shard(how)), _RUN)
    # A piece that follows itself begins again within a string's length: its spans are one.
    start = F.col("at") + F.col("first")
    end = F.col("at") + (F.col("times") - 1) * F.col("many") + F.col("last") + how.length
    spans = found.join(repeated, ["g", "r"]).select(
        "k1", "k2", F.struct(start.alias("start"), end.alias("end")).alias("span")
    )
    # Copies of a text report the same spans.
    return texts, spans.distinct().groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))


def _merged(spans: pa.ListScalar) -> list[tuple[int, int]]:
    """Maximal runs of the spans; runs that touch are one."""
    values = spans.values
    if values is None or not len(values):
        return []
    start, end = values.field("start").to_numpy(), values.field("end").to_numpy()
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    cuts = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return list(zip(start[cuts].tolist(), reach[np.append(cuts[1:], len(start)) - 1].tolist()))


def _remaining(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in runs:
        kept.append(body[at:start])
        at = end
    return b"".join([*kept, body[at:]])


def _attached(docs: DataFrame, text: str, how: Repeats) -> DataFrame:
    """The rows of ``docs`` with their spans as the last column."""
    _, spans = repeated_spans(docs, text, how)
    names = docs.columns
    k1, k2 = text_key(text_of(text))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    found = spans.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans"))
    return keyed.join(found, ["__k1", "__k2"], "left").select(*names, "__spans")


def removal_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """What the removal does to each row: ``key, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes if a string of ``how.length`` bytes covers it that also starts
    anywhere else, in the same text or in another row; strings are judged on
    the input. Texts are UTF-8; a null text is empty, and texts shorter than a
    string lose nothing. Rows that repeat are copies of each other. Null keys
    are passed on; other columns are ignored.
    """

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sizes, removed, counts, hashes = [], [], [], []
            for value, spans in zip(batch.column(1), batch.column(2)):
                body = (value.as_py() or "").encode()
                runs = _merged(spans)
                sizes.append(len(body))
                removed.append(sum(end - start for start, end in runs))
                counts.append(len(runs))
                hashes.append(hashlib.sha256(_remaining(body, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(hashes, pa.string())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = T.StructType().add("id", docs.schema[key].dataType)
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema.add(name, "long")
    schema.add("kept_sha256", "string")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return _attached(rows, "text", how).mapInArrow(digest, schema).withColumnRenamed("id", key)


def remove_repeats(docs: DataFrame, text: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """The rows with all their columns and the text that is left; a null text stays null.

    Where a removed run begins or ends inside a character, the rest of that
    character goes as well, so that what is left is UTF-8.
    """
    names = docs.columns
    place = names.index(text)

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = []
            for value, spans in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                runs = _merged(spans)
                whole = value.as_py()
                texts.append(_remaining(whole.encode(), runs).decode("utf-8", "ignore") if runs else whole)
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _attached(docs, text, how).mapInArrow(cut, docs.schema)
