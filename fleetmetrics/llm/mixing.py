"""Mixing documents to target weights of domains they belong to in part.

A classifier fitted to labelled documents gives every document a posterior over
domains. Each document gets a rate, how often it is to be taken; the tokens that
the rates put into the domains, by expectation, are fitted to the targets by
projected gradient descent on their squared distance, with no rate below 0. The
rates start at 1 and move no further than the fit needs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .tables import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHAPE_IDS = 1 << 30  # features: words below, then runs of shapes, then shares of distinct words
SHARE_IDS = 1 << 31
SAMPLE_DOCS = 12_000
LEAST_DOCS = 5  # a feature must be in so many documents of the sample
LEAST_SPLIT = 5.0  # and stray so many standard deviations from chance in some domain
FIT_STEPS = 200
STEP = 0.3
PENALTY = 1e-4
ITERATIONS = 25  # steps of plain descent; then they are scaled, which brings the last percents in few passes
TOLERANCE = 1e-3
STILL = 1e-3  # a step that takes less of the squared distance off is none
LEAST_DAMP = 1e-6
UNITS = 1024  # expected tokens are summed in whole 1/UNITS, so that sums do not depend on their order

# Bytes as a word's letters (others end the word), and as shapes.
LETTER = arrays.LOWER.copy()
LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 32
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = ord("a")
SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")


@dataclass(frozen=True)
class DomainModel:
    """A multinomial logistic model: the features it knows, in order, each one's weight for each domain, and a bias."""

    domains: tuple[str, ...]
    features: np.ndarray
    weights: np.ndarray  # [features, domains]
    bias: np.ndarray


def _features(body: np.ndarray, bounds: np.ndarray, powers: arrays.Powers) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's number of words and its distinct features.

    Features are the words in small letters, runs of four shapes of characters,
    and the share of distinct words in tenths.
    """
    rows = len(bounds) - 1
    tokens = arrays.per_row(arrays.words(body, bounds)[2], rows).tolist()
    letters = LETTER[body]
    starts, ends, owner = arrays.words(letters, bounds)
    hashes = arrays.span_hashes(arrays.prefix_sums(letters, powers), starts, ends, powers)
    words = (hashes >> np.uint64(34)).astype(np.int64)
    shape = SHAPE[body].astype(np.uint32)
    n = max(0, len(body) - 3)
    packed = np.zeros(n, np.uint32)
    for back in range(4):
        packed = (packed << np.uint32(8)) | shape[back:back + n]
    grams = ((packed * np.uint32(2654435769)) >> np.uint32(20)).astype(np.int64)
    cuts = np.searchsorted(owner, np.arange(rows + 1)).tolist()
    places = bounds.tolist()
    seen = np.zeros(1 << 12, bool)
    for row in range(rows):
        own = np.sort(words[cuts[row]:cuts[row + 1]])
        distinct = own[arrays.first_of_runs(own)]
        seen[grams[places[row]:max(places[row], places[row + 1] - 3)]] = True
        shapes = np.flatnonzero(seen)
        seen[shapes] = False
        share = [SHARE_IDS + 10 * len(distinct) // len(own)] if len(own) else []
        yield tokens[row], np.concatenate([distinct, shapes + SHAPE_IDS, np.array(share, np.int64)])


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _logits(model: DomainModel, features: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack(
        [model.bias[d] + np.bincount(rows, weights=model.weights[features, d], minlength=n)
         for d in range(len(model.domains))], axis=1,
    )


def _known(model: DomainModel, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the known ones among the features of several rows, and their rows."""
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    every = np.concatenate([np.zeros(0, np.int64), *found])
    if not len(model.features):
        return every[:0], rows[:0]
    place = np.minimum(np.searchsorted(model.features, every), len(model.features) - 1)
    same = model.features[place] == every
    return place[same], rows[same]


def _fit(found: list[np.ndarray], label: np.ndarray, domains: tuple[str, ...]) -> DomainModel:
    """Choose the features that domains differ in, then fit by full gradient steps, scaled for each weight."""
    n, width = len(label), len(domains)
    ids, feature = np.unique(np.concatenate(found), return_inverse=True)
    rows = np.repeat(np.arange(n), [len(f) for f in found])
    share = np.bincount(label, minlength=width) / n
    seen = np.bincount(feature, minlength=len(ids))
    stray = np.zeros(len(ids))
    for d in range(width):
        expected = seen * share[d]
        held = np.bincount(feature[label[rows] == d], minlength=len(ids))
        stray = np.maximum(stray, np.abs(held - expected) / np.sqrt(expected * (1 - share[d]) + 1e-9))
    chosen = (seen >= LEAST_DOCS) & (stray >= LEAST_SPLIT)
    model = DomainModel(domains, ids[chosen], np.zeros((chosen.sum(), width)), np.log(n * share + 1.0))
    feature, rows = _known(model, found)
    target = np.eye(width)[label]
    moved, moved_bias = np.full(model.weights.shape, 1e-8), np.full(width, 1e-8)
    for _ in range(FIT_STEPS):
        error = (_softmax(_logits(model, feature, rows, n)) - target) / n
        step = np.stack(
            [np.bincount(feature, weights=error[rows, d], minlength=len(model.features)) for d in range(width)], axis=1
        ) + PENALTY * model.weights
        moved += step**2
        model.weights[:] -= STEP * step / np.sqrt(moved)
        total = error.sum(axis=0)
        moved_bias += total**2
        model.bias[:] -= STEP * total / np.sqrt(moved_bias)
    return model


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain",
    sample_docs: int = SAMPLE_DOCS,
) -> DomainModel:
    """Fit the classifier to at most ``sample_docs`` labelled keys, those with the least hash.

    ``labels`` has the key and the name of a domain; null keys, null domains and
    keys without a document are left out, a key labelled twice counts twice. The
    sample is bounded, so one task fits it. Labels of one domain only, or none,
    give a model that puts every document there, or nowhere.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(domain).isNotNull())
    sample = (
        known.select(F.col(key).alias("id"), F.col(domain).alias("domain"), F.xxhash64(F.col(key)).alias("h"))
        .orderBy("h", "id", "domain").limit(sample_docs).drop("h")
    )
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    # sample_docs rows of a key and a name: a bounded table.
    rows = texts.join(F.broadcast(sample), "id").select("id", "text", "domain")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = arrays.Powers(arrays.BASES[0])
        for batch in batches:
            for at, end, body, bounds in arrays.chunks(batch.column("text")):
                packed = [found.tobytes() for _, found in _features(body, bounds, powers)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, end - at), batch.column("domain").slice(at, end - at),
                     pa.array(packed, pa.binary())],
                    ["id", "domain", "features"],
                )

    schema = T.StructType().add("id", docs.schema[key].dataType).add("domain", "string").add("features", "binary")
    seen = stored(rows.mapInArrow(describe, schema), "labelled-features")
    domains = tuple(r[0] for r in seen.select("domain").distinct().orderBy("domain").collect())

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = [], []
        for batch in batches:
            names += batch.column("domain").to_pylist()
            found += [np.frombuffer(f.as_buffer(), np.int64) for f in batch.column("features")]
        if not names:
            return
        model = _fit(found, np.array([domains.index(n) for n in names]), domains)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (model.features, model.weights, model.bias)],
            ["features", "weights", "bias"],
        )

    ordered = seen.orderBy("id", "domain", F.xxhash64("features")).coalesce(1)
    fitted = ordered.mapInArrow(fit, "features binary, weights binary, bias binary").collect()
    if not fitted:
        return DomainModel((), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    return DomainModel(
        domains, np.frombuffer(fitted[0]["features"], np.int64),
        np.frombuffer(fitted[0]["weights"]).reshape(-1, len(domains)), np.frombuffer(fitted[0]["bias"]),
    )


def posteriors(model: DomainModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each whole text the posterior over domains, in 1/65536, and the number of its words."""
    powers = arrays.Powers(arrays.BASES[0])
    out, tokens = np.zeros((len(column), len(model.domains))), np.zeros(len(column), np.int64)
    for at, end, body, bounds in arrays.chunks(column):
        found = []
        for row, (words, own) in enumerate(_features(body, bounds, powers)):
            tokens[at + row] = words
            found.append(own)
        if model.domains:
            out[at:end] = _softmax(_logits(model, *_known(model, found), end - at))
    return np.rint(out * 65536).astype(np.int64) / 65536, tokens


def memberships(
    docs: DataFrame, model: DomainModel, key: str = "doc_id", text: str = "text",
    counter: Callable[[pa.Array], np.ndarray] | None = None,
) -> DataFrame:
    """Each row's tokens and posterior: ``key, n_tokens, posterior``, in the order of ``model.domains``.

    Tokens are words unless ``counter`` counts other ones of each text.
    """
    kept = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))  # no larger than the sample's features

    def tell(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = DomainModel(**kept.value)  # plain arrays travel to workers without this package
        for batch in rows:
            chance, tokens = posteriors(known, batch.column("text"))
            if counter is not None:
                tokens = counter(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(tokens), pa.array(chance.tolist(), pa.list_(pa.float64()))],
                ["id", "n_tokens", "posterior"],
            )

    schema = T.StructType().add("id", docs.schema[key].dataType).add("n_tokens", "long").add(
        "posterior", T.ArrayType(T.DoubleType())
    )
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(tell, schema).withColumnRenamed("id", key)


def _rates(chance: np.ndarray, steps: list[np.ndarray], scale: float = 1.0) -> np.ndarray:
    """Rates after the steps, times the scale; a document's rate depends on its posterior alone."""
    rate = np.ones(len(chance))
    for step in steps:
        rate = np.maximum(0.0, rate - chance @ step)
    return rate * scale


def fit_rates(
    members: DataFrame, targets: np.ndarray, iterations: int | None = None, tolerance: float = TOLERANCE
) -> list[np.ndarray]:
    """The gradient steps that bring the expected tokens of each domain to the targets, as far as rates of 0 or more can."""
    return descend(members, targets, iterations, tolerance)[0]


def descend(
    members: DataFrame, targets: np.ndarray, iterations: int | None = None, tolerance: float = TOLERANCE
) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps of ``fit_rates``, and the expected tokens of each domain that they reach.

    ``targets`` are tokens by domain. Each iteration is one pass that sums, by
    domain, tokens times rate times posterior; a residual counts in proportion
    to the domain's tokens at rate 1, for which a step size of 1 is safe. After
    ITERATIONS such steps the next are scaled by the second moments of the
    posteriors of documents with a rate above 0, damped so far that the distance
    falls. It ends within the tolerance of the targets, or, where no rates meet
    them, when neither a scaled nor a plain step takes off more than STILL; with
    ``iterations`` after as many steps at the latest.
    """
    width = len(targets)

    def summer(steps: list[np.ndarray]):
        def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width + 1, width), np.int64)  # the tokens, then their second moments
            for batch in rows:
                chance = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                tokens = batch.column("n_tokens").to_numpy()
                rate = _rates(chance, steps)
                total[0] += np.rint(chance * (tokens * rate)[:, None] * UNITS).astype(np.int64).sum(axis=0)
                moved = chance * (tokens * (rate > 0))[:, None] * UNITS
                for d in range(width):
                    total[d + 1] += np.rint(moved * chance[:, d:d + 1]).astype(np.int64).sum(axis=0)
            places = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total.reshape(-1))], ["place", "tokens"])

        return add

    def expected(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sums = members.select("n_tokens", "posterior").mapInArrow(summer(steps), "place long, tokens long")
        out = np.zeros((width + 1) * width)
        for row in sums.groupBy("place").agg(F.sum("tokens").alias("tokens")).collect():
            out[row["place"]] = row["tokens"] / UNITS
        return out[:width], out[width:].reshape(width, width)

    steps: list[np.ndarray] = []
    now, moments = expected(steps)
    mass = np.maximum(now, 1.0)
    damp, tried, still = 1.0, 0, 0
    while np.abs(now - targets).sum() > tolerance * max(targets.sum(), 1.0) and still < 2:
        if iterations is not None and tried >= iterations:
            break
        residual = now - targets
        plain = tried < ITERATIONS
        step = residual / mass if plain else np.linalg.solve(moments + damp * np.diag(mass), residual)
        reached, further = expected([*steps, step])
        tried += 1
        before, after = (residual**2 / mass).sum(), ((reached - targets) ** 2 / mass).sum()
        if plain or after < before:
            steps, now, moments = [*steps, step], reached, further
        if plain:
            continue
        ended = before - after <= STILL * before and (after >= before and damp >= 1 or after < before and damp <= 1e-3)
        still = still + 1 if ended else 0 if after < before else still
        damp = max(damp / 10, LEAST_DAMP) if after < before else damp * 4
    return steps, now


def with_rates(members: DataFrame, steps: list[np.ndarray], scale: float = 1.0) -> DataFrame:
    """The memberships with ``rate``."""
    schema = T.StructType([*members.schema.fields]).add("rate", "double")

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lists = batch.column("posterior")
            chance = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_rates(chance, steps, scale))], schema.names)

    return members.mapInArrow(add, schema)


def _unit(key: Column) -> Column:
    """A number from 0 to below 1 that the key decides."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(5), key), 11).cast("double") * F.lit(2.0**-53)


def copies(rate: Column, key: Column | None = None) -> Column:
    """How often a document is taken: the nearest whole number, or, with a key, a rounding that its hash decides.

    The hash's rounding takes a document with rate 0.3 three times out of ten,
    the same document each time.
    """
    if key is None:
        return F.floor(rate + 0.5).cast("int")
    unit = _unit(key)
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")


@dataclass(frozen=True)
class Mix:
    """The model, its documents' ``key, n_tokens, posterior``, and the steps and the scale that lead to their rates.

    ``targets`` and ``reached`` are the tokens by domain, in the model's order,
    that were asked for and that the rates give by expectation, before the scale;
    None where nothing was fitted.
    """

    model: DomainModel
    members: DataFrame
    steps: list[np.ndarray]
    scale: float = 1.0
    targets: np.ndarray | None = None
    reached: np.ndarray | None = None

    def rates(self) -> DataFrame:
        return with_rates(self.members, self.steps, self.scale)

    def take(self, docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
        """The documents with all their columns, each as often as its rate says, rounded as ``copies`` does.

        With a key the tokens taken have the rates' sums as their expectation. A
        null key is rounded by its text.
        """
        kept = docs.sparkSession.sparkContext.broadcast(dict(vars(self.model)))
        place, steps, scale = docs.columns.index(text), self.steps, self.scale
        unit = F.lit(0.0)
        if key is not None:
            unit = F.when(F.col(key).isNull(), _unit(F.col(text))).otherwise(_unit(F.col(key)))
        beside = max(docs.columns, key=len) + "_"  # no other column's name

        def repeat(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = DomainModel(**kept.value)
            for batch in rows:
                chance, _ = posteriors(model, batch.column(place))
                rate = _rates(chance, steps, scale)
                if key is None:
                    times = np.floor(rate + 0.5).astype(np.int64)
                else:
                    units = batch.column(batch.num_columns - 1).to_numpy()
                    times = (np.floor(rate) + (units < rate - np.floor(rate))).astype(np.int64)
                own = batch.select(range(batch.num_columns - 1))
                yield own.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))

        return docs.withColumn(beside, unit).mapInArrow(repeat, docs.schema)


def mix(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], key: str = "doc_id", text: str = "text",
    domain: str = "domain", budget: float | None = None, sample_docs: int = SAMPLE_DOCS,
    whole: Collection[str] = (), iterations: int | None = ITERATIONS,
    counter: Callable[[pa.Array], np.ndarray] | None = None,
) -> Mix:
    """Fit classifier and rates.

    ``weights`` are the shares of tokens that the domains are to have; a domain
    that they do not name gets 0. Tokens are words, or what ``counter`` counts. ``budget`` is the tokens of all together; by
    default the most for which no domain needs more tokens than its documents
    hold by expectation, so that rates stay near 1 or below. With ``whole`` it is
    the least that leaves each of these domains the tokens it holds, however
    scarce another domain is; documents of a scarce one repeat. Where documents
    of one domain belong to another in a part beyond its target, no rates meet
    all targets; those that come closest are scaled, as a larger budget would.
    With ``iterations`` None the descent goes on until the targets are met, or
    are as near as they can be; else it ends after so many steps, and ``reached``
    tells how far it came.
    A null text has no words and the posterior of an empty one. Null keys are
    passed on and rows with equal texts get equal rates. Without labels, or where
    no domain with a weight has any, posteriors tell nothing and every rate is 1.
    """
    model = train(docs, labels, key, text, domain, sample_docs)
    members = stored(memberships(docs, model, key, text, counter), "memberships")
    share = np.array([float(weights.get(d, 0.0)) for d in model.domains])
    if share.sum() <= 0:
        return Mix(model, members, [])
    held = [F.sum(F.rint(F.col("n_tokens") * F.col("posterior")[d] * UNITS).cast("long")) for d in range(len(share))]
    mass = np.array([(x or 0) / UNITS for x in members.agg(*held).first()])
    kept = np.array([d in whole for d in model.domains]) & (share > 0) & (mass > 0)
    if budget is not None:
        kept[:] = False
    else:
        budgets = mass[share > 0] / (share / share.sum())[share > 0]
        budget = float(budgets[kept[share > 0]].max() if kept.any() else budgets.min())
    targets = share / share.sum() * budget
    steps, reached = descend(members, targets, iterations)
    # The rates that come closest to a multiple of the targets are that multiple of those found.
    lacking = [mass[d] / reached[d] for d in np.flatnonzero(kept) if reached[d] > 0]
    return Mix(model, members, steps, max(lacking, default=1.0), targets, reached)
