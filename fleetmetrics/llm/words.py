"""Words of UTF-8 texts as bytes, a bounded run of words at a time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN_BYTES = 1 << 22


def word_table(digits: bool) -> bytes:
    """A table for ``bytes.translate``: A-Z become small, and what is no part of a word a space.

    Letters, all bytes above ASCII and, if wanted, digits are parts of words.
    """
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    table[97:123] = table[65:91] = b"abcdefghijklmnopqrstuvwxyz"
    if digits:
        table[48:58] = b"0123456789"
    return bytes(table)


def runs(body: np.ndarray, table: bytes, limit: int = RUN_BYTES) -> Iterator[bytes]:
    """The text through the table, cut at spaces into runs of about ``limit`` bytes; a longer word stays whole."""
    at = 0
    rest = b""
    while at < len(body):
        rest += body[at:at + limit].tobytes().translate(table)
        at += limit
        cut = len(rest) if at >= len(body) else rest.rfind(b" ")
        if cut > 0:
            yield rest[:cut]
            rest = rest[cut:]
