import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetmetrics.llm import mixing
from fleetmetrics.llm.queries import QUERIES, domain_labels

SF = "/root/testdata/sf0.01"


def members(spark, posteriors, tokens):
    rows = [(i, int(t), [float(x) for x in p]) for i, (p, t) in enumerate(zip(posteriors, tokens))]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(3)
    chance = np.rint(rng.dirichlet([0.4, 0.4, 0.4], 500) * 65536) / 65536
    tokens = rng.integers(1, 2000, 500)
    targets = np.array([0.6, 0.3, 0.1]) * tokens.sum()
    df = members(spark, chance, tokens)
    found = mixing.with_rates(df, mixing.fit_rates(df, targets, 200)).orderBy("doc_id").collect()
    rate = np.array([r.rate for r in found])
    assert (rate >= 0).all()
    assert np.abs((rate * tokens) @ chance - targets).sum() <= 2e-3 * targets.sum()


def test_rates_are_those_of_a_local_descent(spark):
    chance, tokens = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]), np.array([10, 20, 30])
    targets = np.array([40.0, 0.0])
    df = members(spark, chance, tokens)
    found = [r.rate for r in mixing.with_rates(df, mixing.fit_rates(df, targets, 25, 0.0)).orderBy("doc_id").collect()]
    rate, mass = np.ones(3), tokens @ chance
    for _ in range(25):
        rate = np.maximum(0, rate - chance @ (((rate * tokens) @ chance - targets) / mass))
    assert np.allclose(found, rate, atol=1e-3)
    assert found[2] == 0


@pytest.fixture(scope="module")
def mixed(spark):
    return mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), domain_labels(spark, SF), corpus_pipeline.WEIGHTS)


def test_domains_of_labelled_documents(spark, mixed):
    """Documents that were not learned from: a model of half the labels (200 documents) on the other half."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), domain_labels(spark, SF)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = mixing.train(docs, labels.where(even))
    held = mixing.memberships(docs, model).join(labels.where(~even), "doc_id").collect()
    right = sum(model.domains[int(np.argmax(r.posterior))] == r.domain for r in held)
    assert len(held) > 100 and right >= 0.8 * len(held)


def test_taken_documents(spark, mixed, tables):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = mixed.take(docs)
    assert taken.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    rates = {r.doc_id: r.rate for r in mixed.rates().collect()}
    assert counts == {k: int(np.floor(r + 0.5)) for k, r in rates.items() if r >= 0.5}
    labels = domain_labels(spark, SF).collect()
    toxic = [r.doc_id for r in labels if r.domain == "toxic"]  # a third of these have no word that tells
    assert sum(k in counts for k in toxic) <= 0.4 * len(toxic)
    clean = [r.doc_id for r in labels if r.domain == "clean"]
    assert sum(counts.get(k, 0) == 1 for k in clean) >= 0.99 * len(clean)


def test_edge_rows(documents, edges):
    df = documents(edges)
    labels = df.selectExpr("doc_id", "case when doc_id < 5 then 'a' when doc_id < 9 then 'b' end as domain")
    mixed = mixing.mix(df, labels, {"a": 1.0, "b": 1.0})
    found = mixed.rates().collect()
    assert len(found) == len(edges) and all(r.rate >= 0 and len(r.posterior) == 2 for r in found)
    repeated = [r for r in found if r.doc_id == 9]
    assert repeated[0] == repeated[1]
    assert mixed.take(df).columns == df.columns


def test_without_labels_or_rows(documents, edges):
    df = documents(edges)
    none = df.selectExpr("doc_id", "cast(null as string) as domain")
    mixed = mixing.mix(df, none, {"a": 1.0})
    assert {r.rate for r in mixed.rates().collect()} == {1.0}
    assert mixed.take(df).count() == len(edges)
    assert mixing.mix(documents([]), none, {"a": 1.0}).rates().count() == 0


def test_rounding_by_hash(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1.3).alias("rate"))
    total = docs.agg(F.sum(mixing.copies(F.col("rate"), F.col("doc_id")))).first()[0]
    assert abs(total / 20_000 - 1.3) < 0.02


def test_scarce_domain_leaves_the_clean_ones_whole(spark, monkeypatch):
    """Toxic holds half a percent of the tokens, junk 0.8 %; the texts say which domain they are of."""
    share = {"clean": 9_870, "junk": 80, "toxic": 50}
    names = [name for name, n in share.items() for _ in range(n)]
    posterior = {"clean": [0.996, 0.002, 0.002], "junk": [0.005, 0.99, 0.005], "toxic": [0.005, 0.005, 0.99]}
    rows = [(i, name) for i, name in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    model = mixing.DomainModel(tuple(share), np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros(3))
    monkeypatch.setattr(mixing, "train", lambda *_: model)
    known = spark.createDataFrame([(i, 100, posterior[name]) for i, name in rows],
                                  "doc_id long, n_tokens long, posterior array<double>")
    monkeypatch.setattr(mixing, "memberships", lambda *_: known)
    mixed = mixing.mix(docs, docs, corpus_pipeline.WEIGHTS, whole=corpus_pipeline.WHOLE)
    rates = {r.doc_id: r.rate for r in mixed.rates().collect()}
    assert min(rates[i] for i, name in rows if name == "clean") >= 0.99
    counts = mixed.rates().select("doc_id", mixing.copies(F.col("rate"), F.col("doc_id")).alias("n")).collect()
    taken = {r.doc_id: r.n for r in counts}
    tokens = sum((taken[i] * np.array(posterior[name]) for i, name in rows), np.zeros(3))
    assert np.abs(tokens / tokens.sum() - [0.96, 0.02, 0.02]).max() <= 0.005


def test_taken_by_key(spark, mixed):
    """The copies are those of the hash's rounding, and the tokens taken come near the rates' sums."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = {r.doc_id: r["count"] for r in mixed.take(docs, key="doc_id").groupBy("doc_id").count().collect()}
    said = mixed.rates().select("doc_id", "n_tokens", "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("n"))
    rows = said.collect()
    assert counts == {r.doc_id: r.n for r in rows if r.n}
    total = sum(r.n_tokens * r.rate for r in rows)
    assert abs(sum(r.n_tokens * r.n for r in rows) - total) <= 0.03 * total


def test_copies_of_rows_without_a_key(spark, mixed):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('word ', id) as text")
    rate = mixing.Mix(mixed.model, mixed.members, [], 0.4).take(docs, key="doc_id").count() / 4000
    assert abs(rate - 0.4) < 0.03


@pytest.mark.parametrize("weights", [[0.94, 0.04, 0.02], [0.9, 0.05, 0.05]])
def test_default_descent_meets_targets(spark, weights):
    """Soft posteriors, most rates of the large domain held at 0: plain steps get there after hundreds."""
    rng = np.random.default_rng(1)
    sharp = np.full((3, 3), 0.5) + np.eye(3) * 8.5
    chance = np.rint([rng.dirichlet(sharp[d]) * 65536 for d in rng.choice(3, 2000, p=[0.3, 0.6, 0.1])]) / 65536
    tokens = rng.integers(1, 2000, 2000)
    targets = np.array(weights) * ((tokens @ chance) / weights).min()
    df = members(spark, chance, tokens).localCheckpoint()
    steps, reached = mixing.descend(df, targets)
    rate = np.array([r.rate for r in mixing.with_rates(df, steps).orderBy("doc_id").collect()])
    assert (rate >= 0).all() and (rate == 0).mean() > 0.1
    assert np.abs((rate * tokens) @ chance - targets).sum() <= 1.1e-3 * targets.sum()
    assert np.allclose((rate * tokens) @ chance, reached, rtol=1e-3)


def test_targets_out_of_reach_end_the_descent(spark):
    """Every document belongs to the second domain in a tenth at least; the first alone is asked for."""
    chance, tokens = np.array([[0.9, 0.1], [0.5, 0.5]] * 20), np.full(40, 100)
    steps, reached = mixing.descend(members(spark, chance, tokens), np.array([1800.0, 0.0]))
    mass, best = tokens @ chance, np.array([0.9, 0.1])
    rate = (best * [1800.0, 0.0] / mass).sum() / (best**2 / mass).sum()  # of tokens like the first row's alone
    assert len(steps) < 60 and np.allclose(reached, rate * best, rtol=1e-2)


def test_query_meets_its_targets(spark):
    """The registered query's rates give the shares that it asks for."""
    rows = QUERIES["op5_soft_mixing"](spark, SF).collect()
    tokens = sum(np.array([r.p_clean, r.p_junk, r.p_toxic]) * r.n_tokens * r.rate for r in rows)
    assert np.abs(tokens / tokens.sum() - [0.94, 0.04, 0.02]).sum() <= 1.1e-3


def test_mix_tells_what_it_reached(spark, mixed):
    rows = mixed.rates().collect()
    found = sum(np.array(r.posterior) * r.n_tokens * r.rate for r in rows) / mixed.scale
    assert np.allclose(found, mixed.reached, rtol=1e-3)
    assert mixed.targets.argmax() == mixed.model.domains.index("clean")
