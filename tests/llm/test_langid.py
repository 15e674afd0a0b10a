import zlib

import numpy as np
import pytest

from fleetmetrics.llm import langid


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_code_lengths_are_those_of_the_counts(spark):
    """Two languages, counted and escaped by hand in plain dictionaries over bytes."""
    texts = {"xx": "abracadabra abra", "yy": "\u0440\u0430\u0431\u043e\u0442\u0430 \u6f22 Abra"}
    docs = spark.createDataFrame([(0, t, k) for k, t in texts.items()], "doc_id long, text string, lang string")
    model = langid.train(docs)
    counts: dict = {}
    for lang, text in texts.items():
        line = b"   " + text.encode()
        for i in range(3, len(line)):
            for order in range(4):
                own = counts.setdefault((lang, line[i - order:i]), {})
                own[line[i]] = own.get(line[i], 0) + 1

    def bits(chance):
        return int(np.rint(-np.log2(chance) * langid.UNITS))

    def cost(lang, context, byte):
        if context is None:
            return 8 * langid.UNITS
        own = counts.get((lang, context), {})
        shorter = cost(lang, context[1:] if context else None, byte) if byte not in own else 0
        whole = sum(own.values()) + len(own)
        return 0 + shorter if not own else bits(own[byte] / whole) if byte in own else bits(len(own) / whole) + shorter

    import pyarrow as pa

    probes = [*texts.values(), "cab", "zzz", "", "\u0440\u0430b \u6f23", "Abracadabra" * 3]
    found = langid.code_lengths(model, pa.array(probes))
    for row, probe in enumerate(probes):
        line = b"   " + probe.encode()
        for place, lang in enumerate(model.languages):
            want = sum(cost(lang, line[i - 3:i], line[i]) for i in range(3, len(line)))
            assert found[row, place] == want


def test_hash_tables():
    rng = np.random.default_rng(1)
    for size in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 2**32, size, dtype=np.uint64)).astype(np.uint32)
        table = langid._table(keys)
        assert (langid._rows(table, keys) == np.arange(len(keys))).all()
        other = np.setdiff1d(rng.integers(0, 2**32, 1000, dtype=np.uint64).astype(np.uint32), keys)
        assert (langid._rows(table, other) == -1).all()


def test_repeated_rows_do_not_hide_a_language(spark):
    """Twenty thousand equal rows of one language beside a few hundred of another."""
    docs = spark.range(20_300).selectExpr(
        "id as doc_id",
        "if(id < 20000, 'das ist der eine satz den alle haben', concat('the words of an english text number ', id)) as text",
        "if(id < 20000, 'de', 'en') as lang",
    )
    model = langid.train(docs, docs_per_language=100)
    assert model.languages == ("de", "en")


def test_scripts_are_told_apart(spark):
    """Languages whose letters share most of their bytes with other scripts."""
    words = {
        "ru": "\u0434\u043e\u043c \u043a\u043e\u0442 \u043b\u0435\u0441 \u0441\u043e\u043d \u043c\u0438\u0440", "uk": "\u0434\u0456\u043c \u043a\u0456\u0442 \u043b\u0456\u0441 \u0441\u043e\u043d \u0441\u0432\u0456\u0442",
        "el": "\u03c3\u03c0\u03af\u03c4\u03b9 \u03b3\u03ac\u03c4\u03b1 \u03b4\u03ac\u03c3\u03bf\u03c2", "ja": "\u5bb6 \u732b \u306f \u68ee \u306e \u5922", "ko": "\uc9d1 \uace0\uc591\uc774 \uc232 \uafc8",
    }
    rows = [(i, " ".join(ws.split()[(i + j) % len(ws.split())] for j in range(12)), k) for k, ws in words.items() for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    found = langid.identify(docs, model).where("held_out").join(docs, "doc_id").where("lang_pred = lang")
    assert found.count() > 0
    names, _ = langid.predict(model, __import__("pyarrow").array([r[1] for r in rows]))
    assert names == [r[2] for r in rows]


def test_a_worker_without_the_package(spark, model, tmp_path):
    """What is broadcast can be read where this package is not installed."""
    import pickle
    import subprocess
    import sys

    (tmp_path / "m").write_bytes(pickle.dumps(langid._plain(model)))
    code = f"import pickle; m = pickle.load(open({str(tmp_path / 'm')!r}, 'rb')); print(len(m['languages']))"
    done = subprocess.run([sys.executable, "-I", "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert done.stdout.strip() == str(len(model.languages)), done.stderr


def test_other_languages_go(documents, model):
    df = documents([(1, "this is the house that they have built with the others"), (2, "das ist nicht das Haus, das wir haben"), (3, "...")])
    found = langid.keep_languages(df, model, ["de", "fr"]).collect()
    assert [(r.doc_id, r.lang) for r in found] == [(2, "de")]
    assert langid.keep_languages(df, model, ["de", "en"], min_score=1.1).count() == 0


def test_edge_rows(documents, edges, model):
    df = documents(edges)
    found = langid.identify(df, model).collect()
    assert len(found) == len(edges)
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert und == {1, 2, 3, 7, 10} and all(r.score == 0 for r in found if r.lang_pred == "und")
    kept = langid.keep_languages(df, model, model.languages)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, _ in edges if k not in und)


def test_nothing_to_learn_from(documents):
    model = langid.train(documents([]))
    assert model.languages == ()
    assert [(r.lang_pred, r.score) for r in langid.identify(documents([(1, "text")]), model).collect()] == [("und", 0.0)]
    assert langid.identify(documents([]), model).count() == 0
