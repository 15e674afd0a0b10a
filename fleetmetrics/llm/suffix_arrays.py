"""Suffix arrays of a shard of texts, and the common prefixes of neighbours, in numpy.

A shard is its pieces one after the other; each piece ends in a terminator of its
own, less than every byte, so that no two suffixes are equal.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from . import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _order(major: np.ndarray, minor: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """Indexes that sort by major, minor and place; one sort of packed numbers where they fit 64 bits."""
    if 3 * bits <= 64:
        width = np.uint64(bits)
        packed = (major.astype(np.uint64) << np.uint64(2 * bits)) | (minor.astype(np.uint64) << width)
        packed |= np.arange(len(place)).astype(np.uint64)  # actives come in any order; their index breaks ties
        return (np.sort(packed) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.lexsort((place, minor, major))


def suffix_array(body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All suffixes in order, by the refinement of Larsson and Sadakane.

    Suffixes are sorted by a few symbols first. A suffix's rank is the place
    where the group of its equals begins; each round sorts the members of every
    group that is left by the rank of the suffix as many symbols on as the group
    agrees in, which doubles what they agree in. Groups of one are done.
    """
    n = len(body)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(n + 1).bit_length()
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # symbols before the terminator
    seen = np.zeros(256, np.int64)
    seen[body] = 1
    width = int(seen.sum() + 1).bit_length()
    symbol = np.cumsum(seen).astype(np.uint64)[body]  # 0 is the terminator
    depth = min(n, max(1, (64 - bits) // width))
    key = np.zeros(n, np.uint64)
    for step in range(depth):
        key <<= np.uint64(width)
        key[:n - step] |= np.where(left[:n - step] > step, symbol[step:], np.uint64(0))
    if depth * width + bits <= 64:
        packed = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
        order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        key = packed >> np.uint64(bits)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    begins = arrays.first_of_runs(key) | (left[order] < depth)
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, slots, 0))
    out = order
    lone = begins & np.append(begins[1:], True)
    active = order[~lone]
    while len(active):
        group = rank[active]
        ends = left[active] == depth
        on = np.minimum(active + depth, n - 1)
        minor = np.where(ends, 0, rank[on] + 1)
        order = _order(group, minor, active, bits)
        active, group, minor = active[order], group[order], minor[order]
        starts = arrays.first_of_runs(group)
        index = np.arange(len(active))
        slots = group + index - np.maximum.accumulate(np.where(starts, index, 0))
        begins = arrays.first_of_runs(group, minor) | (minor == 0)
        out[slots] = active
        rank[active] = np.maximum.accumulate(np.where(begins, slots, 0))
        lone = begins & np.append(begins[1:], True)
        active = active[~lone]
        depth *= 2
    return out


def common_prefixes(body: np.ndarray, bounds: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix in ``order`` the bytes it shares with the one before it; 0 for the first.

    Kasai's carry: a suffix shares with its predecessor at least what the suffix
    some bytes earlier did, less those bytes. Suffixes at multiples of a stride
    are compared first, then those between them, from where the carry ends.
    """
    n = len(body)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    padded = np.concatenate([body, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 1, np.uint64)
    for step in range(8):
        word[:n] |= padded[step:step + n] << np.uint64(8 * step)
    stop = np.repeat(bounds[1:], np.diff(bounds))
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    done = 0
    for stride in (64, 8, 1):
        at = np.arange(0, n, stride)
        if done:
            at = at[at % done != 0]
            carry = np.maximum(shared[at - at % done] - at % done, 0)
        else:
            carry = np.zeros(len(at), np.int64)
        known = before[at] >= 0
        at, carry = at[known], carry[known]
        other = before[at]
        most = np.minimum(stop[at] - at, stop[other] - other)
        shared[at] = np.minimum(carry, most)
        going = np.flatnonzero(carry < most)
        while len(going):
            a, b, length = at[going], other[going], carry[going]
            differ = word[a + length] ^ word[b + length]
            same = differ == 0
            lowest = differ & (~differ + np.uint64(1))
            length += np.where(same, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3)
            carry[going] = length
            shared[a] = np.minimum(length, most[going])
            going = going[same & (length < most[going])]
        done = stride
    return shared[order]
