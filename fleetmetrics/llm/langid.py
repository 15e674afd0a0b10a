"""Language identification by prediction by partial matching (PPM).

One context tree per language over bytes: contexts of 0 to ``ORDER`` bytes, each
with the counts of what followed it. A byte seen after the longest context costs
-log2 of its share there; one that was not costs an escape, as often as the
context had distinct followers, and is tried one byte shorter, down to a uniform
guess of all 256. A text's language is the one whose frozen tree needs the fewest
bits for the whole text.
"""

from __future__ import annotations

import sys
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
ORDER = 3
UNITS = 256  # code lengths are whole multiples of 1/256 bit, so sums do not depend on their order
DOCS_PER_LANGUAGE = 1000
CHARS_PER_DOC = 4096
START = 32  # a text begins as after spaces


@dataclass(frozen=True)
class LanguageModel:
    """Frozen statistics: exact code lengths of runs of bytes, in 1/UNITS bit, for each language.

    Runs of one and two bytes stand at their number; those of three and four
    stand where a hash table says, if any language saw them. ``escapes`` is what
    it costs to leave the context that a run is, 0 where the language never saw it.
    """

    languages: tuple[str, ...]
    one: np.ndarray  # [256, languages], int16: the last byte after no context
    two: np.ndarray  # [65536, languages]: after one byte
    three: np.ndarray  # [runs of three, languages]: after two bytes
    four: np.ndarray  # [runs of four, languages]: after three bytes
    escapes_two: np.ndarray  # [65536, languages]
    escapes_three: np.ndarray  # [runs of three, languages]
    runs_three: tuple[np.ndarray, np.ndarray]  # hash tables: run, and its row or -1
    runs_four: tuple[np.ndarray, np.ndarray]


def held_out(key: Column) -> Column:
    """Whether a document is never learned from; a null key is not held out, and not learned from either."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _runs(body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each byte the number of it and the ORDER bytes before it in its text, the first of them highest."""
    wide = body.astype(np.uint32)
    number = wide.copy()
    since = np.arange(len(body)) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in range(1, ORDER + 1):
        before = np.full(len(body), START, np.uint32)
        before[back:] = wide[:-back] if len(body) > back else wide[:0]
        before[since < back] = START
        number |= before << np.uint32(8 * back)
    return number


def _spread(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places in a table of 2**bits, by multiplicative hashing."""
    return ((keys * np.uint32(2654435769)) >> np.uint32(32 - bits)).astype(np.int64)


def _table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash table with linear probing, a quarter full: at each place a key and its row, or row -1."""
    bits = max(4, int(4 * len(keys) + 1).bit_length())
    held, row = np.zeros(1 << bits, np.uint32), np.full(1 << bits, -1, np.int32)
    left, place = np.arange(len(keys)), _spread(keys, bits)
    while len(left):
        free = row[place] < 0
        first = np.unique(np.where(free, place, -1 - np.arange(len(place))), return_index=True)[1]
        take = first[free[first]]
        held[place[take]], row[place[take]] = keys[left[take]], left[take]
        rest = np.ones(len(left), bool)
        rest[take] = False
        left, place = left[rest], (place[rest] + 1) & ((1 << bits) - 1)
    return held, row


def _rows(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The rows of the keys, -1 for those that are not in the table."""
    held, row = table
    bits = len(held).bit_length() - 1
    place = _spread(keys, bits)
    out = row[place]
    open_ones = np.flatnonzero((out >= 0) & (held[place] != keys))
    place = place[open_ones]
    while len(open_ones):
        place = (place + 1) & (len(held) - 1)
        found = row[place]
        out[open_ones] = found
        on = (found >= 0) & (held[place] != keys[open_ones])
        open_ones, place = open_ones[on], place[on]
    return out


def _counter(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            part = batch.filter(pa.array([x == lang for x in langs])).column("text")
            for _, _, body, bounds in arrays.chunks(part):
                seen, n = np.unique(_runs(body, bounds), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(n)],
                    ["lang", "run", "n"],
                )


def _bits(chance: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(chance) * UNITS).astype(np.int64)


class _Tree:
    """One language's counts: of the runs of 1 to 4 bytes, and of the contexts before their last byte."""

    def __init__(self, runs: np.ndarray, n: np.ndarray) -> None:
        self.levels = []
        for order in range(ORDER + 1):
            keys, place = np.unique(runs.astype(np.int64) & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
            counts = np.bincount(place, weights=n, minlength=len(keys))
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total = np.bincount(of, weights=counts, minlength=len(contexts))
            kinds = np.bincount(of, minlength=len(contexts))
            own = _bits(counts / (total + kinds)[of])
            self.levels.append((keys, own, contexts, _bits(kinds / (total + kinds))))

    def escapes(self, order: int, contexts: np.ndarray) -> np.ndarray:
        """What it costs to leave contexts of ``order`` bytes; 0 for those never seen."""
        known, cost = self.levels[order][2:]
        place = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        return np.where(known[place] == contexts, cost[place], 0)

    def costs(self, order: int, runs: np.ndarray) -> np.ndarray:
        """The code lengths of the last bytes of runs of ``order`` + 1 bytes after the bytes before."""
        if order < 0:
            return np.full(len(runs), 8 * UNITS)
        known, cost = self.levels[order][:2]
        place = np.minimum(np.searchsorted(known, runs), len(known) - 1)
        shorter = self.costs(order - 1, runs & ((1 << (8 * order)) - 1))
        return np.where(known[place] == runs, cost[place], self.escapes(order, runs >> 8) + shorter)


def _frozen(languages: tuple[str, ...], trees: list[_Tree]) -> LanguageModel:
    def of(tell, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(trees)), np.int16)
        for place, tree in enumerate(trees):
            out[:, place] = np.minimum(tell(tree, keys), 32767)
        return out

    every = lambda order, part: np.unique(np.concatenate(
        [np.zeros(0, np.int64), *(t.levels[order][part] for t in trees)]
    ))
    four, three = every(3, 0), np.union1d(every(2, 0), every(3, 2))
    return LanguageModel(
        languages,
        of(lambda t, k: t.costs(0, k), np.arange(256)), of(lambda t, k: t.costs(1, k), np.arange(65536)),
        of(lambda t, k: t.costs(2, k), three), of(lambda t, k: t.costs(3, k), four),
        of(lambda t, k: t.escapes(2, k), np.arange(65536)), of(lambda t, k: t.escapes(3, k), three),
        _table(three.astype(np.uint32)), _table(four.astype(np.uint32)),
    )


def train(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
    chars_per_doc: int = CHARS_PER_DOC,
) -> LanguageModel:
    """Fit the trees to a bounded sample of the labelled documents that are not held out.

    Of each language at most ``docs_per_language`` different texts are used, those
    with the least hash, and ``chars_per_doc`` characters of each; rows that repeat
    a text count as one. An estimate of the different texts of each language
    tells how low a hash must be for a document to be looked at, so that few more
    than these are moved. Counting is spread over tasks; the driver gets the
    counts, whose number the sample bounds, and makes the tables, which grow with
    the sample and the number of languages. Without labelled rows the model knows
    no language and calls every text ``und``.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    hashed = known.where(~held_out(F.col(key))).select(
        F.col(lang).alias("lang"),
        F.col(text).alias("text"),
        F.shiftrightunsigned(F.xxhash64(F.col(text)), 11).alias("at"),
    )
    # Half as many again as are wanted: too few would need a chance far below any that matters.
    different = hashed.groupBy("lang").agg(F.approx_count_distinct("at", 0.05).alias("n"))
    share = {r["lang"]: min(1.0, (1.5 * docs_per_language + 100) / max(1, r["n"])) for r in different.collect()}
    low = F.lit(False)
    for name in sorted(share):
        low = low | ((F.col("lang") == name) & (F.col("at") < int(share[name] * 2**53)))
    learned = hashed.where(low).withColumn("text", F.substring("text", 1, chars_per_doc)).groupBy("lang", "at").agg(
        F.min("text").alias("text")
    )
    first = Window.partitionBy("lang").orderBy("at", "text")
    sample = (
        learned.withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= docs_per_language)
        .select("lang", "text").repartition(8)
    )
    counts = (
        sample.mapInArrow(_counter, "lang string, run long, n long")
        .groupBy("lang", "run").agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = tuple(sorted(counts["lang"].unique()))
    own = (counts[counts["lang"] == name] for name in languages)
    return _frozen(languages, [_Tree(c["run"].to_numpy(), c["n"].to_numpy()) for c in own])


def code_lengths(model: LanguageModel, column: pa.Array) -> np.ndarray:
    """The bits, in 1/UNITS, that each language needs for each whole text: [rows, languages]."""
    out = np.zeros((len(column), len(model.languages)), np.int64)
    for at, end, body, bounds in arrays.chunks(column):
        if not len(body):
            continue
        runs = _runs(body, bounds)
        row = _rows(model.runs_four, runs)
        taken = model.four[row].astype(np.int32)
        rare = np.flatnonzero(row < 0)
        if len(rare):
            run = runs[rare]
            context = _rows(model.runs_three, run >> np.uint32(8))
            left = np.where((context >= 0)[:, None], model.escapes_three[context], 0).astype(np.int32)
            shorter = _rows(model.runs_three, run & np.uint32(0xFFFFFF))
            pair = (run & np.uint32(0xFFFF)).astype(np.int64)
            middle = ((run >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
            backed = model.escapes_two[middle].astype(np.int32) + model.two[pair]
            taken[rare] = left + np.where((shorter >= 0)[:, None], model.three[shorter], backed)
        full = np.diff(bounds) > 0
        out[at:end][full] = np.add.reduceat(taken, bounds[:-1][full], axis=0, dtype=np.int64)
    return out


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    out = np.zeros(len(column), bool)
    for at, end, body, bounds in arrays.chunks(column):
        low = body | 32
        seen = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
        out[at:end] = seen[bounds[1:]] > seen[bounds[:-1]]
        other = np.concatenate([[0], np.cumsum(body >= 128)])
        for row in np.flatnonzero(~out[at:end] & (other[bounds[1:]] > other[bounds[:-1]])):
            text = body[bounds[row]:bounds[row + 1]].tobytes().decode("utf-8", "replace")
            out[at + row] = any(map(str.isalpha, text))
    return out


def predict(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and posterior under equal priors of each text; ties go to the first name."""
    if not model.languages:
        return [UNKNOWN] * len(column), np.zeros(len(column))
    bits = code_lengths(model, column)
    best = bits.argmin(axis=1)
    gap = (bits - bits.min(axis=1, keepdims=True)) / UNITS
    score = 1.0 / np.exp2(-gap).sum(axis=1)
    lettered = has_letter(column)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
    return names, np.where(lettered, score, 0.0)


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's language: ``key, held_out, lang_pred, score``.

    The whole text counts and nothing else. ``lang_pred`` is a learned name, or
    ``und`` with score 0 for a text that is null, empty or without letters. The
    score is the language's posterior under equal priors. Rows with equal texts
    get equal answers; a null key is passed on; other columns are ignored.
    """
    kept = docs.sparkSession.sparkContext.broadcast(_plain(model))  # bounded by the sample and the languages

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(**kept.value)
        for batch in rows:
            names, scores = predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held"), pa.array(names, pa.string()), pa.array(scores)],
                ["id", "held", "lang", "score"],
            )

    kind = docs.schema[key].dataType
    schema = T.StructType().add("id", kind).add("held", T.BooleanType()).add("lang", "string").add("score", "double")
    rows = docs.select(F.col(key).alias("id"), held_out(F.col(key)).alias("held"), F.col(text).alias("text"))
    return rows.mapInArrow(score, schema).toDF(key, "held_out", "lang_pred", "score")


def _plain(model: LanguageModel) -> dict:
    """The model as plain arrays, which a worker without this package can read."""
    return dict(vars(model))


def keep_languages(
    docs: DataFrame, model: LanguageModel, languages: Collection[str], min_score: float = 0.0,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The documents, with all their columns, that the model finds to be in one of ``languages``; ``lang`` says in which.

    Those of other languages go, those called ``und``, and those whose predicted
    language has a posterior below ``min_score``. The model can only tell the
    languages it learned apart.
    """
    kept = docs.sparkSession.sparkContext.broadcast(_plain(model))
    place, wanted = docs.columns.index(text), frozenset(languages) - {UNKNOWN}
    told = docs.columns.index(lang)

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(**kept.value)
        for batch in rows:
            names, scores = predict(model, batch.column(place))
            chosen = [n in wanted and s >= min_score for n, s in zip(names, scores.tolist(), strict=True)]
            found = pa.array(names, batch.schema.field(told).type)
            columns = [found if i == told else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(chosen, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
