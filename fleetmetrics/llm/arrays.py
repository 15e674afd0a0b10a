"""Batches of texts as flat numpy arrays: bytes, words, hashes, runs.

Hashes of spans are polynomials modulo 2**64 over the bytes, read off one
running sum: the span from s to e has ``(sum[e] - sum[s]) * base**-s``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The row code of this subpackage travels with its tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 19
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they have inverses modulo 2**64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the bounds of its rows in them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        raise TypeError(f"text or binary expected, not {column.type}")
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    size = np.dtype(width).itemsize
    bounds = np.frombuffer(offsets, width, len(column) + 1, column.offset * size).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[bounds[0]:bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most ``limit`` bytes, a longer row alone: first row, end row, bytes, bounds."""
    body, bounds = flat(column)
    at, rows = 0, len(bounds) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, end, body[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at]
        at = end


class Powers:
    """Powers of a base and of its inverse, grown as longer texts come."""

    def __init__(self, base: int) -> None:
        self._bases = (base, pow(base, -1, 1 << 64))
        self._size = 0
        self._kept: list[np.ndarray] = []

    def upto(self, n: int) -> list[np.ndarray]:
        if n > self._size:
            self._size = max(n, CHUNK_BYTES + 1)
            self._kept = []
            for base in self._bases:
                powers = np.full(self._size, base, np.uint64)
                powers[0] = 1
                self._kept.append(np.cumprod(powers, dtype=np.uint64))
        return [p[:n] for p in self._kept]


def prefix_sums(body: np.ndarray, powers: Powers) -> np.ndarray:
    """Running sums of byte times power; a byte counts as its value plus one, so that no byte is void."""
    up, _ = powers.upto(len(body) + 1)
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:len(body)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    _, down = powers.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, which are runs of other than ASCII white space, and the row of each."""
    inside = ~SPACE[body]
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    begins[firsts] = inside[firsts]
    lasts = firsts[1:] - 1
    stops[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def per_row(owner: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(owner, minlength=rows).astype(np.int64)


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the element before; the first element counts."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for key in keys:
            out[1:] |= key[1:] != key[:-1]
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indexes of the spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.arange(total) + np.repeat(shift, lengths)


def batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
