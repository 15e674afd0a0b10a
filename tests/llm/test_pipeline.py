"""The stages on the smallest tables, each against a plain reading of what it should do."""

import collections
import re

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from fleetmetrics.llm import packing
from fleetmetrics.llm.queries import ORACLES, QUERIES
from checks.compare import database, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that each stage returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "stage")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(df.columns == names for df in stages[:-1])
    assert {"doc_id", "sequence_id", "offset"} <= set(stages[-1].columns)


def test_languages(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert set(after) == {k for k, t in before.items() if any(map(str.isalpha, t or ""))}
    given = {r.doc_id: r.lang for r in stages[0].collect()}
    told = {r.doc_id: r.lang for r in stages[1].collect()}
    assert sum(given[k] == told[k] for k in told) >= 0.99 * len(told)


def test_documents_of_other_languages_go(spark, monkeypatch):
    """The languages are a choice, and what is predicted to be in another is dropped."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("de", "fr"))
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    given = {r.doc_id: r.lang for r in docs.collect()}
    assert set(kept.values()) == {"de", "fr"}
    wanted = {k for k, lang in given.items() if lang in ("de", "fr")}
    assert len(set(kept) & wanted) >= 0.99 * len(wanted) and len(set(kept) - wanted) <= 0.01 * len(given)


def test_texts_that_share_an_id_stay(spark, documents):
    rows = [(1, "one text of its own"), (1, "quite another text here"), (1, "one text of its own"), (2, None), (2, "")]
    df = documents(rows).select("doc_id", "text", "lang", "source", "n_chars")
    kept = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup(spark, df, SF).collect())
    assert kept == [(1, "one text of its own"), (1, "quite another text here"), (2, "")]


def test_near_copies(stages):
    before, after = texts(stages[1]), texts(stages[2])
    sets = {}
    for key, text in before.items():
        parts = (text or "").encode().lower().split()
        sets[key] = {tuple(parts[i:i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    assert set(after) == {k for k in sets if find(k) == k}


def test_repeats(stages):
    before, after = texts(stages[2]), texts(stages[3])
    seen = collections.Counter()
    for text in before.values():
        body = text.encode()
        seen.update(body[i:i + 200] for i in range(len(body) - 199))
    for key, text in before.items():
        body = text.encode()
        gone = bytearray(len(body))
        for i in range(len(body) - 199):
            if seen[body[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        left = bytes(b for b, g in zip(body, gone) if not g).decode("utf-8", "ignore")
        assert after.get(key, "").strip() == left.strip() or key in after and after[key] == left


def test_mixing(spark, stages):
    before, after = texts(stages[3]), collections.Counter(r.doc_id for r in stages[4].collect())
    assert set(after) <= set(before)
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [k for k in before if labels.get(k) == (1, 0)]
    assert sum(after[k] == 1 for k in clean) >= 0.97 * len(clean)
    toxic = [k for k in before if labels.get(k, (1, 0))[1] == 1]
    assert sum(after[k] > 0 for k in toxic) <= 0.5 * len(toxic)


def test_packing(stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[4].select("doc_id").collect()}
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 1
    # The ids of a document's pieces are those of the text that the stage before kept.
    full = Tokenizer.from_file(packing.public_vocabulary()["json_path"])
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, tuple(r.ids)))
    once = [r for r in stages[4].collect() if len(set(pieces[r.doc_id])) == len(pieces[r.doc_id])]
    assert len(once) > 100
    for r in once:
        ids = [i for _, part in sorted(pieces[r.doc_id]) for i in part]
        assert ids == [*full.encode(r.text, add_special_tokens=False).ids, 2]


def test_edge_rows(spark, documents, edges):
    df = documents(edges).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.stored(stage(spark, df, SF), "stage")
    assert df.where("doc_id = 4").count() == 1 and df.where("doc_id is null").count() == 1
    df = documents([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.stored(stage(spark, df, SF), "stage")
    assert df.count() == 0


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_twins(spark, name):
    ours = QUERIES[name](spark, SF).toPandas()
    theirs = database(SF).execute(ORACLES[name]).df()
    clean = lambda frame: [tuple(c.replace("<NA>", "NULL") for c in r) for r in rows_of(frame)]
    assert len(ours) and clean(ours) == clean(theirs)
