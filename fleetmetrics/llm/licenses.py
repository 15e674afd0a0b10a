"""License scans: template markup compiled into token automata.

A template is wording with two kinds of free regions, in the markup of public
license templates: ``<<beginOptional>> ... <<endOptional>>`` may be left out,
and ``<<var;name="..";original="..";match="..">>`` stands for other words. All
other wording is mandatory. A template becomes an automaton over words, and a
text holds the license where the automaton accepts: where all mandatory words
stand in order, with nothing between them but what the free regions allow.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .words import RUN_BYTES, runs, word_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VAR_WORDS = 40  # the most words that ``.*`` and ``.+`` stand for

_TABLE = word_table(digits=True)
_MARK = re.compile(r"<<(.*?)>>", re.S)
_START = -1

SPANS = "array<struct<label string, base boolean, first_word long, last_word long>>"


@dataclass(frozen=True)
class Template:
    """A license's wording with its markup, and the label it gives; ``base`` tells plain phrases from the rest."""

    label: str
    markup: str
    base: bool = False


@dataclass
class Automaton:
    """All templates as one automaton: a position for each word of each template, and which may follow which."""

    labels: list[tuple[str, bool]] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)  # position -> template
    share: list[float] = field(default_factory=list)  # position -> share of the mandatory words met when it is reached
    by_word: list[dict[bytes, tuple[int, ...]]] = field(default_factory=list)  # position -> next word -> positions
    by_any: list[tuple[int, ...]] = field(default_factory=list)  # position -> positions any word leads to
    ends: frozenset[int] = frozenset()
    starts: dict[bytes, tuple[int, ...]] = field(default_factory=dict)
    seeds: list[bytes] = field(default_factory=list)  # " one two " or " one ": how an accepted run can begin


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def _var(options: str) -> tuple:
    """A replaceable region: ("any", least, most) words, or ("either", the wordings)."""
    found = re.search(r'match="(.*?)"', options, re.S)
    match = found[1] if found else ".+"
    counted = re.fullmatch(r"\.\{(\d+),(\d+)\}", match)
    if match in (".*", ".+"):
        return "any", int(match == ".+"), VAR_WORDS
    if counted:
        return "any", int(counted[1]), int(counted[2])
    wordings = match.strip("()").split("|")
    if re.search(r"[\\\[\](){}.*+?^$]", "".join(wordings)):
        raise ValueError(f"no region of words: {match}")
    return "either", [[("word", w) for w in _words(one)] for one in wordings]


def parse(markup: str) -> list[tuple]:
    """The regions of a template in order; optional ones hold regions of their own."""
    open_ones: list[list[tuple]] = [[]]
    at = 0
    for mark in _MARK.finditer(markup):
        open_ones[-1] += [("word", w) for w in _words(markup[at:mark.start()])]
        at = mark.end()
        kind = mark[1].split(";")[0].strip()
        if kind == "beginOptional":
            open_ones.append([])
        elif kind == "endOptional":
            if len(open_ones) < 2:
                raise ValueError("an optional region ends that did not begin")
            inner = open_ones.pop()
            open_ones[-1].append(("optional", inner))
        elif kind == "var":
            open_ones[-1].append(_var(mark[1]))
        else:
            raise ValueError(f"unknown mark: {kind}")
    if len(open_ones) > 1:
        raise ValueError("an optional region does not end")
    return open_ones[0] + [("word", w) for w in _words(markup[at:])]


def compile_templates(templates: Iterable[Template]) -> Automaton:
    """One automaton for all templates.

    A template has to begin with a word, be it optional, and cannot match
    nothing at all: else every word of every text would begin a match.
    """
    made = Automaton()
    words: list[bytes | None] = []
    follow: list[set[int]] = []
    first: set[int] = set()
    ends: set[int] = set()

    def place(word: bytes | None, before: set[int]) -> set[int]:
        here = len(words)
        words.append(word)
        follow.append(set())
        made.owner.append(len(made.labels) - 1)
        for b in before:
            (first if b == _START else follow[b]).add(here)
        return {here}

    def build(regions: Sequence[tuple], before: set[int], must: bool) -> set[int]:
        nonlocal met
        for kind, *what in regions:
            if kind == "word":
                met += must
                before = place(what[0], before)
                made.share.append(met)
            elif kind == "optional":
                before = before | build(what[0], before, False)
            elif kind == "any":
                out: set[int] = set()
                for n in range(what[1]):
                    out |= before if n >= what[0] else set()
                    before = place(None, before)
                    made.share.append(met)
                before = before | out
            else:
                before = set().union(*(build(one, before, False) for one in what[0]))
        return before

    for template in templates:
        made.labels.append((template.label, template.base))
        met, begin = 0, len(words)
        last = build(parse(template.markup), {_START}, True)
        if _START in last or not met:
            raise ValueError(f"{template.label}: no mandatory wording")
        made.share[begin:] = [n / met for n in made.share[begin:]]
        ends |= last
    if any(words[p] is None for p in first):
        raise ValueError("a template begins with a replaceable region")

    def named(places: set[int]) -> dict[bytes, tuple[int, ...]]:
        out: dict[bytes, tuple[int, ...]] = {}
        for p in sorted(places):
            if words[p] is not None:
                out[words[p]] = (*out.get(words[p], ()), p)
        return out

    made.by_word = [named(f) for f in follow]
    made.by_any = [tuple(sorted(p for p in f if words[p] is None)) for f in follow]
    made.ends = frozenset(ends)
    made.starts = named(first)
    seeds: set[bytes] = set()
    for p in first:
        if p in ends or made.by_any[p]:
            seeds.add(b" %s " % words[p])
        seeds |= {b" %s %s " % (words[p], after) for after in made.by_word[p]}
    made.seeds = sorted(s for s in seeds if not any(s != o and s.startswith(o) for o in seeds))
    return made


def scan(body: np.ndarray, machine: Automaton, limit: int = RUN_BYTES) -> tuple[int, dict, float]:
    """Words of a text, its accepted places, and the largest share of a template's mandatory words met in order.

    Places are ``{(template, first word): last word}``, with the longest of those
    that begin alike; of runs that meet in one position the earliest is followed.
    Words are looked at one by one only while some template is under way, so the
    time is linear in the text whatever stands in it.
    """
    states: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    best = 0.0
    done = 0  # words before this run
    carried = b""

    def enter(new: dict[int, int], at: int) -> None:
        nonlocal states, best
        states = new
        for p, start in new.items():
            best = max(best, machine.share[p])
            if p in machine.ends:
                found[machine.owner[p], start] = at

    for run in runs(body, _TABLE, limit):
        words = run.split()
        if not words:
            continue
        # The last word of the run before comes again, so that no pair of words is cut.
        again = 1 if carried else 0
        words = [carried, *words] if again else words
        line = b" %s " % b" ".join(words)
        seeds = set()
        for seed in machine.seeds:
            at = line.find(seed)
            while at >= 0:
                seeds.add(at)
                at = line.find(seed, at + 1)
        places, counted, upto = [], 0, 0
        for at in sorted(seeds):
            counted += line.count(b" ", upto, at)
            upto = at
            places.append(counted)
        base = done - again
        if again and places and places[0] == 0:
            begun = {p: base for p in machine.starts.get(words[0], ())}
            enter({**begun, **states}, base)
        at, nth = again, 0
        while True:
            while nth < len(places) and places[nth] < at:
                nth += 1
            if not states:
                if nth == len(places):
                    break
                at = places[nth]
            if at >= len(words):
                break
            word = words[at]
            new: dict[int, int] = {}
            for p, start in states.items():
                for following in (machine.by_word[p].get(word, ()), machine.by_any[p]):
                    for q in following:
                        if start < new.get(q, start + 1):
                            new[q] = start
            if nth < len(places) and places[nth] == at:
                for q in machine.starts.get(word, ()):
                    new.setdefault(q, base + at)
            enter(new, base + at)
            at += 1
        done = base + len(words)
        carried = words[-1]
    return done, found, best


def scan_licenses(
    docs: DataFrame, templates: Sequence[Template], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The templates that each whole text holds: ``key, n_words, spans, score``.

    ``spans`` lists each accepted place with its template's label, whether it is
    a base phrase, and its first and last word, by first word; places may
    overlap. The score is the largest share of a template's mandatory words that
    stand in the text in order: 1 where one is accepted, 0 where none begins. Texts
    are read as words of letters, digits and all beyond ASCII, A-Z as a-z. A null
    or empty text has no words and no spans; rows that repeat are scanned each
    for itself, a null key is passed on, and other columns are ignored.
    """
    machine = docs.sparkSession.sparkContext.broadcast(_plain(compile_templates(templates)))  # as large as the templates
    kind = T.DataType.fromDDL(SPANS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(**machine.value)
        for batch in batches:
            body, bounds = arrays.flat(batch.column("text"))
            counts, spans, scores = [], [], []
            for start, end in zip(bounds[:-1], bounds[1:]):
                n, found, best = scan(body[start:end], automaton)
                counts.append(n)
                scores.append(best)
                spans.append([
                    {"label": automaton.labels[which][0], "base": automaton.labels[which][1], "first_word": at,
                     "last_word": last}
                    for (which, at), last in sorted(found.items(), key=lambda one: (one[0][1], one[1], one[0][0]))
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(spans, arrow_spans), pa.array(scores, pa.float64())],
                ["id", "n_words", "spans", "score"],
            )

    arrow_spans = pa.list_(pa.struct([
        ("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64())
    ]))
    schema = T.StructType().add("id", docs.schema[key].dataType).add("n_words", "long").add("spans", kind).add("score", "double")
    whole = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return whole.mapInArrow(rows, schema).withColumnRenamed("id", key)


def _plain(machine: Automaton) -> dict:
    """The automaton as plain lists, which any worker can read."""
    return dict(vars(machine))


def digest(found: DataFrame) -> DataFrame:
    """The spans of ``scan_licenses`` as columns: base places, their first and last start, and the labels."""
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))))
    starts = F.transform(base, lambda s: s["first_word"])
    return (
        found.withColumn("n_base", F.size(base).cast("long"))
        .withColumn("first_word", F.array_min(starts)).withColumn("last_word", F.array_max(starts))
        .withColumn("base_labels", joined(base)).withColumn("labels", joined(F.col("spans")))
    )
