"""Quality rules: counts of every document, and a log-likelihood ratio of hashed n-grams.

The n-grams are runs of ``GRAM`` bytes, which fall into ``BUCKETS`` by a hash;
runs of bytes tell clean text from junk in words never seen before. Two
multinomials over the buckets are counted, one over trusted documents and one
over the whole corpus. A document's score is the mean, over its n-grams, of the
log of the ratio of the two chances, and one threshold decides for all.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .tables import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SMOOTHING = 1.0
GRAM = 4
UNITS = 1 << 16  # ratios are whole multiples of 1/UNITS nat, so sums do not depend on their order
SCORE_BINS = 4096
SCORE_RANGE = 4.0  # nats per n-gram; scores beyond count in the outer bins

# Characters that count as symbols; fixed values.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(flags)])
    return seen[ends] - seen[starts]


def _repeated_in_windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of ``size`` words that is found twice or more in their row."""
    n = len(hashes) - size + 1
    covered = np.zeros(len(hashes) + 1, np.int64)
    if n < 1:
        return covered[:-1].astype(bool)
    window = np.zeros(n, np.uint64)
    for back in range(size):
        window = window * np.uint64(arrays.BASES[1]) + hashes[back:back + n]
    window = arrays.mix(window ^ (owner[:n].astype(np.uint64) * np.uint64(arrays.BASES[0])))
    whole = np.flatnonzero(owner[:n] == owner[size - 1:])
    order = whole[np.argsort(window[whole])]
    sorted_window = window[order]
    same = sorted_window[1:] == sorted_window[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = order[twice]
    np.add.at(covered, found, 1)
    np.add.at(covered, found + size, -1)
    return np.cumsum(covered[:-1]) > 0


def _duplicate_lines(body: np.ndarray, bounds: np.ndarray, sums: np.ndarray, powers, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row, by row."""
    rows = len(bounds) - 1
    breaks = np.flatnonzero(body == 10)
    begins = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    owner = np.repeat(np.arange(rows), 1 + np.diff(np.searchsorted(breaks, bounds)))
    # The begin after a row's last byte and the next row's begin are the same number: rows deal with it in order.
    ends = np.empty_like(begins)
    ends[:-1] = begins[1:] - 1
    last = np.ones(len(begins), bool)
    last[:-1] = owner[1:] != owner[:-1]
    ends[last] = bounds[1:]
    with_word = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    begins, ends, owner = begins[with_word], ends[with_word], owner[with_word]
    line = arrays.span_hashes(sums, begins, ends, powers)
    line = arrays.mix(line ^ (owner.astype(np.uint64) * np.uint64(arrays.BASES[0])))
    order = np.argsort(line, kind="stable")
    again = order[~arrays.first_of_runs(line[order])]
    return np.bincount(owner[again], minlength=rows)


def _features(body: np.ndarray, bounds: np.ndarray, powers: arrays.Powers):
    """Words of a chunk: starts, ends, row of each, hash of each, running hash sums."""
    starts, ends, owner = arrays.words(body, bounds)
    sums = arrays.prefix_sums(body, powers)
    return starts, ends, owner, arrays.span_hashes(sums, starts, ends, powers), sums


def _grams(body: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of the n-gram at each byte, and where each row's n-grams begin and end."""
    n = max(0, len(body) - GRAM + 1)
    wide = body.astype(np.uint32)
    packed = np.zeros(n, np.uint32)
    for back in range(GRAM):
        packed = (packed << np.uint32(8)) | wide[back:back + n]
    # Multiplicative hashing; the high bits of the product are the well-mixed ones.
    places = (packed * np.uint32(2654435769)) >> np.uint32(33 - buckets.bit_length())
    return places, np.minimum(bounds[:-1], n), np.maximum(np.minimum(bounds[:-1], n), bounds[1:] - GRAM + 1)


def train(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS
) -> np.ndarray:
    """The log of each bucket's chance among trusted documents over its chance in the corpus.

    All documents count, and all whose key is in ``trusted``. Every task adds up
    its documents in two arrays of ``buckets`` numbers and the driver gets their
    sums, which do not grow with the corpus. Null or repeated trusted keys do no
    harm. The answer is in 1/UNITS nat, one number for each bucket.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    marks = trusted.select(F.col(key).alias("id")).where("id is not null").distinct()
    flagged = (
        docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        # Neither side has a bound, so it is a sort-merge join at every size.
        .join(marks.withColumn("trusted", F.lit(True)).hint("merge"), "id", "left")
        .select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    )

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, buckets), np.int64)
        for batch in rows:
            mark = batch.column("trusted").to_numpy(zero_copy_only=False)
            for at, end, body, bounds in arrays.chunks(batch.column("text")):
                places, begins, ends = _grams(body, bounds, buckets)
                totals[0] += np.bincount(places[arrays.ragged(begins, ends - begins)], minlength=buckets)
                begins, ends = begins[mark[at:end]], ends[mark[at:end]]
                totals[1] += np.bincount(places[arrays.ragged(begins, ends - begins)], minlength=buckets)
        seen = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(totals[0][seen]), pa.array(totals[1][seen])], ["bucket", "n", "good"]
        )

    sums = (
        flagged.mapInArrow(count, "bucket long, n long, good long")
        .groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toPandas()
    )
    raw, good = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    raw[sums["bucket"]] += sums["n"]
    good[sums["bucket"]] += sums["good"]
    ratios = np.log(good / good.sum()) - np.log(raw / raw.sum())
    return np.rint(ratios * UNITS).astype(np.int64)


def describe(
    docs: DataFrame, ratios: np.ndarray | None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Counts of each whole text, and its mean log-likelihood ratio.

    Returns ``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    score``; the score is null for a text shorter than an n-gram, or without ratios. A
    null text has no words. Rows that repeat are described each for itself.
    """
    kept = docs.sparkSession.sparkContext.broadcast(ratios)  # as many numbers as buckets

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = arrays.Powers(arrays.BASES[0])
        for batch in rows:
            for at, end, body, bounds in arrays.chunks(batch.column("text")):
                n = end - at
                starts, _, owner, hashes, sums = _features(body, bounds, powers)
                words = arrays.per_row(owner, n)
                chars = _sums(~arrays.SPACE[body] & ((body & 0xC0) != 0x80), bounds[:-1], bounds[1:])
                repeated = _repeated_in_windows(hashes, owner, WINDOW)
                score = np.full(n, np.nan)
                if kept.value is not None:
                    places, begins, ends = _grams(body, bounds, len(kept.value))
                    total = _sums(kept.value[places], begins, ends) / UNITS
                    np.divide(total, ends - begins, out=score, where=ends > begins)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at, n), pa.array(words), pa.array(chars),
                        pa.array(_sums(SYMBOL[body], bounds[:-1], bounds[1:])),
                        pa.array(_duplicate_lines(body, bounds, sums, powers, starts)),
                        pa.array(np.bincount(owner[repeated], minlength=n)),
                        pa.array(score, mask=np.isnan(score)),
                    ],
                    ["id", *names],
                )

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
    schema = T.StructType().add("id", docs.schema[key].dataType)
    for name in names:
        schema.add(name, "double" if name == "score" else "long")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, schema).withColumnRenamed("id", key)


def best_threshold(scored: DataFrame, labels: DataFrame, key: str, good: str) -> float:
    """The score that parts labelled good from other documents with the greatest sum of both shares told right.

    Counted over all labelled rows in ``SCORE_BINS`` bins. Of equal thresholds
    the lowest counts; with rows of one kind only, nothing is refused.
    """
    place = F.floor((F.col("score") + SCORE_RANGE) / (2 * SCORE_RANGE) * SCORE_BINS)
    place = F.greatest(F.lit(0), F.least(F.lit(SCORE_BINS - 1), place)).cast("int")
    marks = labels.select(F.col(key).alias("id"), F.col(good).alias("good")).where("id is not null")
    bins = (
        scored.where("score is not null").select(F.col(key).alias("id"), place.alias("bin"))
        .join(marks, "id").groupBy("bin", "good").count().collect()
    )
    counts = np.zeros((2, SCORE_BINS))
    for row in bins:
        counts[int(bool(row["good"])), row["bin"]] += row["count"]
    if not counts.sum(axis=1).all():
        return float("-inf")
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(counts, axis=1)], axis=1)
    told = below[0] / below[0, -1] + 1 - below[1] / below[1, -1]
    return float(told.argmax() / SCORE_BINS * 2 * SCORE_RANGE - SCORE_RANGE)


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "good",
    trusted: str = "trusted", buckets: int = BUCKETS,
) -> DataFrame:
    """The counts of ``describe`` with ``base_failed`` and ``kept`` for every document.

    ``labels`` has the key and two booleans: ``trusted`` for the documents of the
    target multinomial, and ``good`` for those that the threshold should keep.
    Base rules fail a document with too few words or with too many words in
    repeated windows; of the others those are kept whose score reaches the
    threshold. Without labels of both kinds nothing else is refused.
    """
    trusted = labels.where(F.col(trusted))
    scored = stored(describe(docs, train(docs, trusted, key, text, buckets), key, text), "scores")
    threshold = best_threshold(scored, labels, key, good)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    passed = F.coalesce(F.col("score"), F.lit(0.0)) >= F.lit(threshold)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & passed)
