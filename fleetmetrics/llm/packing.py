"""Packing tokenised documents into sequences by bin completion.

A sequence is filled around the largest piece that is left. Of the sets of
other pieces that fit beside it only those are tried that no other set
dominates (a set dominates another if its pieces, one by one, can take the
other's place), least waste first. A branch ends when the waste so far leaves no
room for fewer sequences than the best packing known; best-fit decreasing gives
the first such packing, and the search ends at the lower bound.
"""

from __future__ import annotations

import base64
import re
import struct
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 1024
END_ID = 2
GROUP_PIECES = 20_000  # pieces that one task packs
SEARCH_NODES = 3_000  # fillings tried in a group beyond the first descent
LOOSE = 16  # a sequence with more than 1/LOOSE of waste is packed once more, with those of other groups
KEPT_WORDS = 300_000

# Special token of the vocabulary file; a fixed value.
SPECIAL = "<|endoftext|>"


# ---------------------------------------------------------------- tokens


class _Words(dict):
    """Token ids, as little-endian 32-bit numbers, of words with the space before them.

    Holds two generations of ``KEPT_WORDS``: a word that is not met while the
    younger one fills up is forgotten, so that frequent words stay.
    """

    def __init__(self, encoding) -> None:
        self._encoding = encoding
        self._older: dict[str, bytes] = {}
        self._marks = {mark: _packed(encoding.encode_ordinary(mark)) for mark in ".,;:!?"}

    def __missing__(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            # A mark after a letter is a token of its own.
            if word[-1:] in self._marks and word[-2:-1].isalpha():
                ids = self[word[:-1]] + self._marks[word[-1]]
            else:
                ids = _packed(self._encoding.encode_ordinary(" " + word))
        if len(self) >= KEPT_WORDS:
            self._older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    """Ids of the byte-level BPE in ``json_path``, from the same merges as ranks in ``ranks_path``.

    The vocabulary's pattern ends a token before a space that follows anything
    but white space, so that a text's ids are those of its space-separated words
    one after the other; words that were met before need no second encoding. A
    text in which white space comes before a space is encoded as a whole, one
    with a special token by the tokenizers library.
    """

    _irregular = re.compile(r"\s ")

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken

        name = f"{ranks_path}\n{pattern}"
        known = tiktoken.registry.ENCODINGS  # outlives a task, as its worker does
        if name not in known:
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            known[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            known[name].words = _Words(known[name])
        self._encoding = known[name]
        self._words = known[name].words
        self._json_path = json_path
        self._full = None

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if SPECIAL in text:
            if self._full is None:
                from tokenizers import Tokenizer

                self._full = Tokenizer.from_file(self._json_path)
            return _packed(self._full.encode(text, add_special_tokens=False).ids)
        if self._irregular.search(text):
            return _packed(self._encoding.encode_ordinary(text))
        first, *rest = text.split(" ")
        head = _packed(self._encoding.encode_ordinary(first))
        return head + b"".join(map(self._words.__getitem__, rest))


def public_vocabulary() -> dict[str, str]:
    """Paths and pattern of the 50k byte-level BPE that the machine offers."""
    import public_tokenizers

    return {
        "json_path": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


def tokenized_pieces(
    docs: DataFrame, vocabulary: dict[str, str], key: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Each document's ids and then ``end_id``, cut where it is longer than a sequence.

    Returns ``key, piece, start, length, ids_crc32`` and, if asked for, ``ids``. A
    longer document is cut into pieces of ``capacity`` ids, with what is left over
    as its first piece.
    """
    end = _packed([end_id])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(**vocabulary)
        for batch in rows:
            names, texts = batch.columns
            owner, piece, start, length, crc, parts = [], [], [], [], [], []
            for row, value in enumerate(texts):
                ids = bpe.ids(value.as_py() or "") + end
                total = len(ids) // 4
                at, nth = 0, 0
                size = total % capacity or capacity
                while at < total:
                    owner.append(row)
                    piece.append(nth)
                    start.append(at)
                    length.append(size)
                    part = ids[4 * at:4 * (at + size)]
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part)
                    at, nth, size = at + size, nth + 1, capacity
            columns = [
                names.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            if with_ids:
                every = pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), every))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = (
        T.StructType().add("id", docs.schema[key].dataType).add("piece", "integer")
        .add("start", "long").add("length", "long").add("ids_crc32", "long")
    )
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", key)


def token_counter(vocabulary: dict[str, str]) -> Callable[[pa.Array], np.ndarray]:
    """A function that tells how many ids the pieces of each text hold, the end id included."""

    def count(column: pa.Array) -> np.ndarray:
        bpe = ByteBpe(**vocabulary)
        return np.array([len(bpe.ids(text.as_py() or "")) // 4 + 1 for text in column], np.int64)

    return count


# ---------------------------------------------------------------- bins


def lower_bound(counts: list[int], capacity: int) -> int:
    """Sequences that any packing needs: by total size, and by pieces too large to share (Martello and Toth)."""
    total = sum(size * n for size, n in enumerate(counts))
    best = -(-total // capacity)
    sizes = [s for s, n in enumerate(counts) if n]
    for small in [0, *(s for s in sizes if 2 * s <= capacity)]:
        large = sum(counts[s] for s in sizes if s > capacity - small)
        middle = [s for s in sizes if 2 * s > capacity and s <= capacity - small]
        halves = sum(counts[s] for s in middle)
        room = halves * capacity - sum(s * counts[s] for s in middle)
        rest = sum(s * counts[s] for s in sizes if small <= s and 2 * s <= capacity)
        best = max(best, large + halves + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: every piece goes where the least room that suffices is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some sequence has room r
    for size in range(capacity, 0, -1):
        for _ in range(counts[size]):
            fitting = open_rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
                bins[at].append(size)
            else:
                room, at = capacity, len(bins)
                bins.append([size])
            left = room - size
            by_room[left].append(at)
            if left:
                open_rooms |= 1 << left
    return bins


class _Stock:
    """Pieces that are left, by size, with bit sets for "is there a piece of this size"."""

    def __init__(self, counts: list[int], capacity: int) -> None:
        self.counts, self.capacity = list(counts), capacity
        self.sizes = sum(1 << s for s, n in enumerate(counts) if n and s)
        self.mirror = sum(1 << (capacity - s) for s, n in enumerate(counts) if n and s)

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.sizes ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)

    def put(self, size: int) -> None:
        if not self.counts[size]:
            self.sizes |= 1 << size
            self.mirror |= 1 << (self.capacity - size)
        self.counts[size] += 1

    def largest(self, limit: int) -> int:
        """The largest size up to the limit, 0 if there is none."""
        return (self.sizes & ((2 << limit) - 1)).bit_length() - 1 if self.sizes & ((2 << limit) - 1) else 0

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """Two sizes of this sum, the larger first."""
        both = self.sizes & (self.mirror >> (self.capacity - total))
        both &= -(1 << ((total + 1) // 2))
        while both:
            high = both.bit_length() - 1
            both ^= 1 << high
            if 2 * high != total or self.counts[high] > 1:
                yield high, total - high

    def triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        """Three sizes of this sum, from the largest down."""
        sizes = self.sizes & ((2 << total) - 1)
        smallest = (sizes & -sizes).bit_length() - 1
        while (high := sizes.bit_length() - 1) * 3 >= total >= 3 * smallest > 0:
            sizes ^= 1 << high
            rest = total - high
            if self.sizes & (self.mirror >> (self.capacity - rest)):
                self.take(high)
                found = [pair for pair in self.pairs(rest) if pair[0] <= high]
                self.put(high)
                for a, b in found:
                    yield high, a, b

    def beside(self, room: int, other: int) -> int:
        """The largest size that fits beside the other one."""
        found = self.largest(room - other)
        return self.largest(other - 1) if found == other and self.counts[other] == 1 else found


def _closings(stock: _Stock, room: int, total: int) -> Iterator[tuple[int, ...]]:
    """Sets of two pieces with this sum or, if there are none, of three; a set that fills the room needs no test."""
    paired = False
    for a, b in stock.pairs(total):
        if total == room or stock.beside(room, a) <= b and stock.beside(room, b) <= a:
            paired = True
            yield a, b
    if paired:
        return  # pairs of the same sum leave the smaller pieces for later
    for a, b, c in stock.triples(total):
        if total == room or stock.beside(room, a) < b + c:
            yield a, b, c


def fillings(stock: _Stock, room: int, most_waste: int) -> Iterator[tuple[int, ...] | None]:
    """Sets of few pieces for the room that waste no more than told, the fullest first; not all there are.

    Where more than three pieces fit, the largest go in first and sets of one to
    three close the rest. A set no fuller than the largest single piece that
    fits is dominated by that piece. A sum that no set has yields None, so that
    the caller can count it as work. Between two results the stock is as it was.
    """
    head: list[int] = []
    while (size := stock.largest(room)) and 4 * size <= room:
        stock.take(size)
        head.append(size)
        room -= size
    lone = stock.largest(room)
    smallest = (stock.sizes & -stock.sizes).bit_length() - 1
    for size in head:
        stock.put(size)
    if lone < room and 2 * smallest <= room:
        for total in range(room, max(lone, 2 * smallest - 1, room - most_waste - 1), -1):
            for size in head:
                stock.take(size)
            for closing in _closings(stock, room, total):
                for size in head:
                    stock.put(size)
                yield (*head, *closing)
                for size in head:
                    stock.take(size)
            for size in head:
                stock.put(size)
            yield None
    yield (*head, lone) if lone else tuple(head)


def every_filling(
    stock: _Stock, room: int, allowed: Callable[[], int], told: set[tuple[int, ...]]
) -> Iterator[tuple[int, ...]]:
    """All undominated sets of any number of pieces for the room that are not ``told`` yet, the fullest first.

    Sums that the pieces cannot make are passed over by what the smaller sizes
    reach, so every step leads to a set. Left out are sets beside which one more
    piece fits, and those of which a piece, or two together, can be exchanged
    for a larger piece that is left: what is packed with such a set can also be
    packed with the other one. Sets no fuller than the largest piece that fits
    are dominated by it.
    """
    sizes = [s for s in range(min(room, stock.capacity), 0, -1) if stock.counts[s]]
    if not sizes:
        if () not in told:
            yield ()
        return
    counts = {s: stock.counts[s] for s in sizes}
    reach = [1]  # the sums that the sizes from here on make, as bits; the last is that of none
    within = (2 << room) - 1
    for size in reversed(sizes):
        sums, copies, step = reach[-1], min(counts[size], room // size), 1
        while copies:
            step = min(step, copies)
            sums |= (sums << size * step) & within
            copies, step = copies - step, 2 * step
        reach.append(sums)
    reach.reverse()

    def sets(total: int, at: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for i in range(at, len(sizes)):
            if not reach[i] >> total & 1:
                return
            size = sizes[i]
            for n in range(min(counts[size], total // size), 0, -1):
                if reach[i + 1] >> (total - n * size) & 1:
                    for rest in sets(total - n * size, i + 1):
                        yield (size,) * n + rest

    def dominated(filling: tuple[int, ...]) -> bool:
        spare = room - sum(filling)
        if not spare and len(filling) < 2:
            return False
        left = stock.sizes
        for size in set(filling):
            if stock.counts[size] == filling.count(size):
                left ^= 1 << size
        if left & ((2 << spare) - 1):
            return True
        distinct = sorted(set(filling))
        if any(left >> (size + 1) & ((1 << spare) - 1) for size in distinct):
            return True
        pairs = ((a, b) for i, a in enumerate(distinct) for b in distinct[i:] if a != b or filling.count(a) > 1)
        return any(left >> (a + b) & ((2 << spare) - 1) for a, b in pairs)

    lone, total = sizes[0], room
    while total > lone and room - total <= allowed():
        if reach[0] >> total & 1:
            for filling in sets(total, 0):
                if filling not in told and not dominated(filling):
                    yield filling
        total -= 1
    if (lone,) not in told and room - lone <= allowed():
        yield (lone,)


def completions(stock: _Stock, room: int, allowed: Callable[[], int]) -> Iterator[tuple[int, ...] | None]:
    """Fillings of the room: those of few pieces first, which mostly do, then all others that are undominated."""
    told = set()
    for filling in fillings(stock, room, allowed()):
        if filling is not None:
            told.add(tuple(sorted(filling, reverse=True)))
        yield filling
    yield from every_filling(stock, room, allowed, told)


_NO_MORE = (0,)


def bin_completion(counts: list[int], capacity: int, nodes: int = SEARCH_NODES) -> list[list[int]]:
    """Few sequences for ``counts[size]`` pieces of each size, as lists of sizes; see :func:`search`."""
    return search(counts, capacity, nodes)[0]


def search(counts: list[int], capacity: int, nodes: int = SEARCH_NODES) -> tuple[list[list[int]], bool]:
    """The best packing found, and whether no other can have fewer sequences.

    That is known if the search ended by itself or met the lower bound; it is cut
    after ``nodes`` fillings beyond one descent.
    """
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    if len(best) == bound:
        return best, True
    whole = sum(size * n for size, n in enumerate(counts))
    stock = _Stock(counts, capacity)
    left, tries, waste = sum(counts[1:]), nodes + 4 * len(best), 0
    levels: list[tuple[int, Iterator[tuple[int, ...]]]] = []
    chosen: list[tuple[int, ...]] = []
    lost: list[int] = []

    descended = False  # the first descent, always by the fullest set, is walked to its end: one more incumbent

    def allowed() -> int:  # the waste that any better packing may still have
        return (len(best) - 1) * capacity - whole - waste if descended else capacity

    def open_level() -> None:
        size = stock.largest(capacity)
        stock.take(size)
        levels.append((size, completions(stock, capacity - size, allowed)))

    open_level()
    while levels and tries:
        size, options = levels[-1]
        if len(chosen) == len(levels):  # back from below: undo this level's filling
            for piece in chosen.pop()[1:]:
                stock.put(piece)
                left += 1
            left += 1
            waste -= lost.pop()
        tries -= 1
        filling = next(options, _NO_MORE)
        if filling is None:
            continue
        if filling is _NO_MORE:
            stock.put(size)
            levels.pop()
            continue
        spare = capacity - size - sum(filling)
        if spare > allowed():
            continue
        for piece in filling:
            stock.take(piece)
        left -= 1 + len(filling)
        chosen.append((size, *filling))
        lost.append(spare)
        waste += spare
        if left:
            open_level()
        else:
            descended = True
            if len(chosen) < len(best):
                best = [list(c) for c in chosen]
                if len(best) == bound:
                    return best, True
    return best, not levels


def _pack_group(capacity: int, nodes: int, first_id: int):
    def pack(pieces: pa.Table) -> pa.Table:
        group = pieces.column("group")[0].as_py()
        sizes = pieces.column("length").to_numpy()
        order = np.argsort(sizes, kind="stable")
        counts = np.bincount(sizes, minlength=capacity + 1).tolist()
        next_of = np.concatenate([[0], np.cumsum(counts)[:-1]]).tolist()
        sequence = np.zeros(len(sizes), np.int64)
        offset = np.zeros(len(sizes), np.int64)
        spare = np.zeros(len(sizes), np.int64)
        for nth, bin_sizes in enumerate(bin_completion(counts, capacity, nodes)):
            at, rows = 0, []
            for size in bin_sizes:
                row = order[next_of[size]]
                next_of[size] += 1
                offset[row] = at
                at += size
                rows.append(row)
            sequence[rows] = nth
            spare[rows] = capacity - at
        sequence += (first_id + group) << 32
        return (
            pieces.drop_columns(["group"])
            .append_column("sequence_id", pa.array(sequence))
            .append_column("offset", pa.array(offset))
            .append_column("spare", pa.array(spare))
        )

    return pack


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, nodes: int = SEARCH_NODES
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, in as few sequences as the search finds.

    ``pieces`` has a ``length`` from 1 to the capacity. Groups of about
    ``group_pieces`` are dealt by row and packed one per task; the sequences of
    each group that stay loose are packed once more together, so that the loss
    by grouping does not grow with the number of groups.
    """
    columns = pieces.columns
    kept = stored(pieces, "pieces")

    def packed(rows: DataFrame, count: int, first_id: int) -> DataFrame:
        groups = max(1, -(-count // group_pieces))
        schema = T.StructType([*pieces.schema.fields])
        for name in ("sequence_id", "offset", "spare"):
            schema.add(name, "long")
        dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        # Small rows and long work: as many tasks as groups, which adaptive execution leaves alone.
        return dealt.repartition(groups, "group").groupBy("group").applyInArrow(_pack_group(capacity, nodes, first_id), schema)

    count = kept.count()
    groups = max(1, -(-count // group_pieces))
    if groups == 1:
        return packed(kept, count, 0).drop("spare")
    first = stored(packed(kept, count, 0), "packed-pieces")
    loose = first.where(F.col("spare") * LOOSE > capacity)
    again = packed(loose.select(*columns), loose.count(), groups)
    tight = first.where(F.col("spare") * LOOSE <= capacity)
    return tight.unionByName(again).drop("spare")


def pack_documents(
    docs: DataFrame, vocabulary: dict[str, str] | None = None, key: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, nodes: int = SEARCH_NODES,
    with_ids: bool = False,
) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` ids.

    Returns ``key, piece, start, length, ids_crc32, sequence_id, offset`` and, if
    asked for, the piece's ``ids``: a sequence's ids are those of its pieces by
    offset. A null or empty text is one piece, the end id alone. Rows that repeat
    a key or a text are packed each for itself. An empty table gives an empty
    table; other columns are ignored, whatever their names.
    """
    pieces = tokenized_pieces(docs, vocabulary or public_vocabulary(), key, text, capacity, end_id, with_ids)
    if not with_ids:
        return pack_pieces(pieces, capacity, group_pieces, nodes)
    # Only the lengths go through the packing; the ids meet their places afterwards.
    held = stored(pieces.withColumn("at", F.monotonically_increasing_id()), "piece-ids")
    placed = pack_pieces(held.drop("ids"), capacity, group_pieces, nodes)
    return placed.join(held.select("at", "ids"), "at").drop("at")
