import re

import numpy as np

from fleetmetrics.llm import quality


def counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    places: dict = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeated = {j for found in places.values() if len(found) > 1 for i in found for j in range(i, i + 8)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in lines
            lines.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, again, len(repeated)


def answer(df):
    return [
        (r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.score)
        for r in quality.describe(df, None).collect()
    ]


def test_counts_of_the_whole_table(spark, tables):
    texts = dict(tables("select doc_id, text from documents"))
    found = answer(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert {k: c for k, c, _ in found} == {k: counts(t) for k, t in texts.items()}


def test_counts_of_edge_rows(documents, edges):
    rows = [*edges, (30, "a\nb\na\n\na\n \n \nb"), (31, "x y z " * 6), (32, "\n"), (33, "end\n"), (34, "end\n")]
    found = answer(documents(rows))
    assert sorted((str(k), c) for k, c, _ in found) == sorted((str(k), counts(t)) for k, t in rows)
    assert all(score is None for _, _, score in found)


def test_score_is_the_mean_log_ratio(documents):
    docs = documents([(1, "aaaa bbbb"), (2, "cccc dddd"), (3, "aaaa"), (4, "abc"), (None, "aaaa")])
    trusted = docs.where("doc_id in (1, 3)").select("doc_id")
    ratios = quality.train(docs, trusted, buckets=1 << 10)

    def bucket(gram):
        return (int.from_bytes(gram, "big") * 2654435769 % 2**32) >> 22

    def grams(text):
        return [bucket(text[i:i + 4]) for i in range(len(text) - 3)]

    raw, good = np.ones(1024), np.ones(1024)
    for text in (b"aaaa bbbb", b"cccc dddd", b"aaaa", b"abc", b"aaaa"):
        np.add.at(raw, grams(text), 1)
    for text in (b"aaaa bbbb", b"aaaa"):
        np.add.at(good, grams(text), 1)
    expected = np.rint((np.log(good / good.sum()) - np.log(raw / raw.sum())) * quality.UNITS)
    assert (ratios == expected).all()
    found = {r.doc_id: r.score for r in quality.describe(docs, ratios).collect()}
    assert found[2] == expected[grams(b"cccc dddd")].sum() / quality.UNITS / 6
    assert found[4] is None


def test_clean_stays_and_junk_goes(spark):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet").selectExpr(
        "doc_id", "quality = 1 as good", "quality = 1 and toxic = 0 as trusted"
    )
    docs = spark.read.parquet(f"{base}/documents.parquet")
    found = quality.judge(docs, labels).join(labels, "doc_id").collect()
    clean = [r for r in found if r.good and not r.base_failed]
    junk = [r for r in found if not r.good]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(r.kept for r in junk) <= 0.05 * len(junk)
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_without_labels_or_rows(documents, edges):
    none = documents([]).selectExpr("doc_id", "true as good", "true as trusted")
    found = quality.judge(documents(edges), none).collect()
    assert len(found) == len(edges)
    assert all(r.kept != r.base_failed for r in found)
    assert quality.judge(documents([]), none).count() == 0
