"""Source divergence audit: how far each source's words are from those of the others in its language.

Every (language, source) group has a count for each kept term of its language.
The comparison of all groups over all terms is cut in three dimensions: a task
owns one block of groups, another block of groups and one block of terms. It
gets the slices of both blocks of groups, computes its part of each divergence,
and the parts are summed along the terms. All arithmetic is in whole numbers,
so the results do not depend on the cut.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays
from .tables import stored
from .words import runs, word_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DOCS = 10
TOP_TERMS = 10
SMOOTHING = 2
SCALE = 1_000_000_000
GROUP_BLOCK = 32  # groups of a language in a block
TERM_BLOCK = 1024  # terms of a language in a block
COUNTED_AT_ONCE = 400_000  # terms of groups that a task holds before it passes their counts on

_TABLE = word_table(digits=False)
_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group; the empty term holds the group's place."""
    words: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def told() -> Iterator[pa.RecordBatch]:
        for group, seen in words.items():
            terms = list(seen)
            of = docs[group]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group[0]] * len(terms), pa.string()), pa.array([group[1]] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64()),
                    pa.array([of[t] for t in terms], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        body, bounds = arrays.flat(batch.column("text"))
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for row, group in enumerate(groups):
            seen = words.setdefault(group, Counter({b"": 0}))
            of = docs.setdefault(group, Counter())
            before = len(seen)
            distinct: set[bytes] = set()
            for run in runs(body[bounds[row]:bounds[row + 1]], _TABLE):
                terms = run.split()
                seen.update(terms)
                distinct.update(terms)
            of.update(distinct)
            held += len(seen) - before
            if held > COUNTED_AT_ONCE:
                yield from told()
                words, docs, held = {}, {}, 0
    yield from told()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total) for 0 <= count <= total < 2**53, by long division three digits at a time."""
    out = np.zeros(np.broadcast(count, total).shape, np.int64)
    rest = np.broadcast_to(count, out.shape)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so the square fits."""
    return (p - q) ** 2 // (p + q)


def _cell(top: int):
    """The parts that one cell of the cube gives: of pairs of groups, and of groups against their language."""

    def parts(cells: pa.Table, groups: pa.Table) -> pa.Table:
        if not groups.num_rows:
            return empty
        lang = groups.column("lang")[0].as_py()
        left, right = groups.column("bi")[0].as_py(), groups.column("bj")[0].as_py()
        order = np.argsort(np.array(groups.column("source").to_pylist(), object))
        groups = groups.take(pa.array(order))
        names = groups.column("source").to_pylist()
        block = groups.column("b").to_numpy()
        total = groups.column("total").to_numpy()
        vocabulary = int(groups.column("vocabulary")[0].as_py())
        lang_total = int(groups.column("lang_total")[0].as_py())
        place = {name: i for i, name in enumerate(names)}
        coded = cells.column("term").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        spelt = [t.encode() for t in coded.dictionary.to_pylist()]
        # Terms in the order of their UTF-8 bytes, so that of equal values the first place is the first term.
        by_bytes = sorted(range(len(spelt)), key=spelt.__getitem__)
        rank = np.empty(len(spelt), np.int64)
        rank[by_bytes] = np.arange(len(spelt))
        terms = [spelt[i].decode() for i in by_bytes]
        at = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(spelt) else np.zeros(0, np.int64)
        counts = np.zeros((len(names), len(terms)), np.int64)
        row = np.array([place[s] for s in cells.column("source").to_pylist()], np.int64)
        counts[row, at] = cells.column("n").to_numpy()
        everywhere = np.zeros(len(terms), np.int64)
        everywhere[at] = cells.column("n_all").to_numpy()
        size = total + SMOOTHING * vocabulary
        p = shares(counts + SMOOTHING, size[:, None]) if vocabulary else counts
        none = shares(np.full(len(names), SMOOTHING), size) if vocabulary else None
        out: list[tuple] = []
        second = np.flatnonzero(block == right)
        for i in np.flatnonzero(block == left):
            others = second[second > i] if left == right else second
            if not len(others):
                continue
            sums = gaps(p[i][None, :], p[others]).sum(axis=1) if len(terms) else np.zeros(len(others), np.int64)
            rest = gaps(none[i], none[others]) if vocabulary else np.zeros(len(others), np.int64)
            out += [
                (lang, names[i], names[j], None, int(v), vocabulary, len(terms), int(r))
                for j, v, r in zip(others, sums, rest, strict=True)
            ]
        if left == right and vocabulary and len(terms):
            whole = shares(everywhere + SMOOTHING, np.int64(lang_total + SMOOTHING * vocabulary))
            for i, name in enumerate(names):
                above = np.flatnonzero((counts[i] > 0) & (p[i] > whole))
                value = gaps(p[i][above], whole[above])
                best = np.lexsort((above, -value))[:top]
                out += [(lang, name, None, terms[above[k]], int(value[k]), None, None, None) for k in best]
        return pa.table(
            [pa.array(column, f.type) for column, f in zip(zip(*out), schema)], schema=schema
        ) if out else empty

    schema = pa.schema([
        ("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("term", pa.string()),
        ("value", pa.int64()), ("vocabulary", pa.int64()), ("seen", pa.int64()), ("rest", pa.int64()),
    ])
    empty = pa.Table.from_batches([], schema=schema)
    return parts


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts of each language's kept terms by source: ``lang, source, term, n, n_all, heads``.

    ``n_all`` is the term's count in its language, and ``heads`` is 1 in one of
    the rows of each kept term. The empty term, with n 0, stands for each group.
    Each task adds up its documents first, and one shuffle by language and term
    serves the counts and the documents of all sources.
    """
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"),
    )
    of_term = Window.partitionBy("lang", "term")
    return (
        rows.mapInArrow(_count, _COUNTS).repartition("lang", "term")
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .select(
            "lang", "source", "term", "n", F.sum("n").over(of_term).alias("n_all"),
            F.sum("docs").over(of_term).alias("docs"), F.min("source").over(of_term).alias("head"),
        )
        .where((F.col("term") == "") | (F.col("docs") >= min_docs))
        .select(
            "lang", "source", "term", "n", "n_all",
            ((F.col("term") != "") & (F.col("source") == F.col("head"))).cast("long").alias("heads"),
        )
    )


def _block(name: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")


def _all_blocks(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def divergences(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK,
) -> DataFrame:
    """Divergences of each (language, source) group: ``lang, source, part, item, value, rank``.

    Terms are runs of letters, A-Z as a-z. A language keeps the terms of at
    least ``min_docs`` of its documents; a group's p of a term is
    1 + floor(10**9 * (count + 2) / (N + 2V)), with N the sum of its counts and V
    the number of kept terms, and two shares differ by
    floor((p - q)**2 / (p + q)). Part ``pair`` gives the sum over all V terms for
    every other source of the language, part ``term`` the ``top_terms`` terms
    that the group has and holds more of than its language does. Ranks start at 1
    by falling value and rising item.

    A null language or source is empty text and a group like others; null and
    empty texts make a group without terms; each row counts as a document, also
    where it repeats. Without kept terms pairs have the value 0. No rows, no
    results. Counts of a group and its vocabulary below 2**53 in sum are exact.
    """
    cells = stored(term_counts(docs, lang, source, text, min_docs), "term-counts")
    per_lang = Window.partitionBy("lang")
    groups = stored(
        cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("heads").alias("heads"))
        .select(
            "lang", "source", "total", F.sum("heads").over(per_lang).alias("vocabulary"),
            F.sum("total").over(per_lang).alias("lang_total"), F.count("*").over(per_lang).alias("groups"),
        ),
        "groups",
    )
    most = groups.agg(F.max("vocabulary").alias("v"), F.max("groups").alias("g")).first()
    term_blocks = max(1, -(-(most["v"] or 0) // term_block))
    group_blocks = max(1, -(-(most["g"] or 0) // group_block))
    cube = ["lang", "bi", "bj", "k"]
    placed = lambda rows: (
        rows.withColumn("b", _block("source", group_blocks)).withColumn("x", _all_blocks(group_blocks))
        .withColumn("bi", F.least("b", "x")).withColumn("bj", F.greatest("b", "x"))
    )
    slices = placed(
        cells.where("term != ''").withColumn("k", _block("term", term_blocks))
    ).select(*cube, "source", "term", "n", "n_all")
    owners = placed(groups).withColumn("k", _all_blocks(term_blocks)).select(
        *cube, "b", "source", "total", "vocabulary", "lang_total"
    )
    parts = slices.groupBy(*cube).cogroup(owners.groupBy(*cube)).applyInArrow(
        _cell(top_terms),
        "lang string, source string, other string, term string, value long, vocabulary long, seen long, rest long",
    )
    summed = parts.groupBy("lang", "source", "other", "term").agg(
        F.sum("value").alias("value"), F.max("vocabulary").alias("vocabulary"), F.sum("seen").alias("seen"),
        F.max("rest").alias("rest"),
    )
    # Kept terms that no group of both blocks has: all of them differ by the same.
    whole = F.col("value") + (F.col("vocabulary") - F.col("seen")) * F.col("rest")
    pair = lambda source, item: F.struct(
        F.col(source).alias("source"), F.lit("pair").alias("part"), F.col(item).alias("item"), whole.alias("value")
    )
    term = F.struct("source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    # A pair counts for both of its groups; one pass over the parts serves pairs and terms.
    told = F.when(F.col("term").isNull(), F.array(pair("source", "other"), pair("other", "source"))).otherwise(F.array(term))
    found = summed.select("lang", F.explode(told).alias("at")).select("lang", "at.*")
    down = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return (
        found.withColumn("rank", F.row_number().over(down))
        .where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
    )
