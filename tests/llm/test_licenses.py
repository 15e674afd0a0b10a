import random
import re

import duckdb
import numpy as np
import pytest

from fleetmetrics.llm.license_templates import TEMPLATES
from fleetmetrics.llm.licenses import Template, compile_templates, digest, parse, scan, scan_licenses
from fleetmetrics.llm.queries import op13_template_licenses


def body(text):
    return np.frombuffer(text.encode(), np.uint8)


def words_of(text):
    return [w.lower() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]


def accepted_ends(regions, words, at):
    """Brute force: every word after which the regions can have been read from ``at``."""
    if not regions:
        return {at}
    (kind, *what), rest = regions[0], regions[1:]
    if kind == "word":
        firsts = {at + 1} if at < len(words) and words[at].encode() == what[0] else set()
    elif kind == "optional":
        firsts = {at} | accepted_ends(what[0], words, at)
    elif kind == "any":
        firsts = {at + n for n in range(what[0], what[1] + 1) if at + n <= len(words)}
    else:
        firsts = set().union(*(accepted_ends(one, words, at) for one in what[0]))
    return set().union(*(accepted_ends(rest, words, f) for f in firsts)) if firsts else set()


def brute(templates, words):
    """Of each template the set of (first word, last word) of the longest match from each start."""
    return {
        (which, at, max(ends) - 1)
        for which, t in enumerate(templates) for at in range(len(words))
        if (ends := accepted_ends(parse(t.markup), words, at))
    }


SMALL = [
    Template("plain", "a b a", base=True),
    Template("one", "c", base=True),
    Template("free", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d"),
    Template("start", "<<beginOptional>>b<<endOptional>> c a"),
    Template("either", 'd <<var;name="x";original="a";match="a b|c">> a'),
]


@pytest.mark.parametrize("limit", [1, 3, 1 << 20])
def test_accepts_what_brute_force_accepts(limit):
    """Without regions for any word, runs meet only in the same last word; the one that begins first is reported."""
    rng = random.Random(5)
    machine = compile_templates(SMALL)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "c", "d", " ", ". ", "\n"]) + rng.choice(["", " "]) for _ in range(30))
        words = words_of(text)
        n, found, best = scan(body(text), machine, limit)
        assert n == len(words)
        first = {}
        for which, at, last in brute(SMALL, words):
            first[which, last] = min(at, first.get((which, last), at))
        assert {(which, at, last) for (which, at), last in found.items()} == {(w, at, last) for (w, last), at in first.items()}
        assert (best == 1.0) == bool(found)


def test_replaceable_words():
    """Where any words may stand, a template is found if and only if brute force finds it, at the same last words."""
    rng = random.Random(6)
    templates = [
        Template("gap", 'a <<var;name="x";original="y";match=".{1,3}">> b'),
        Template("tail", 'b <<beginOptional>><<var;name="x";original="y";match=".{0,2}">> c<<endOptional>> d'),
    ]
    machine = compile_templates(templates)
    for _ in range(400):
        text = " ".join(rng.choice("abcd") for _ in range(25))
        found = scan(body(text), machine)[1]
        wanted = brute(templates, words_of(text))
        assert {which for which, _ in found} == {which for which, _, _ in wanted}
        assert {(which, at, last) for (which, at), last in found.items()} <= {
            (which, at, end - 1) for which, t in enumerate(templates) for at in range(25)
            for end in accepted_ends(parse(t.markup), words_of(text), at)
        }
        assert {min(at for w, at in found if w == which) for which in {w for w, _ in found}} == {
            min(at for w, at, _ in wanted if w == which) for which in {w for w, _, _ in wanted}
        }


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def labels(text):
    machine = compile_templates(TEMPLATES)
    _, found, best = scan(body(text), machine)
    return sorted({machine.labels[which][0] for which, _ in found}), best


def test_full_notices():
    assert labels("Copyright 2020 Someone\n" + MIT + "\nmore") == (["mit"], 1.0)
    assert labels(MIT.replace("the Software", "those Widgets of ours")) == (["mit"], 1.0)  # replaceable wording
    found, best = labels(MIT.replace("without restriction", "with few restrictions"))  # mandatory wording
    assert found == [] and 0.2 < best < 0.5
    assert labels("This work is licensed under the GNU General Public License, version 3.")[0] == ["gpl-3"]
    assert labels("under the terms of the GNU General Public License as published by the Free Software Foundation,"
                  " either version 3 of the License")[0] == ["gpl-3"]
    assert labels("under the GNU Lesser General Public License")[0] == ["lgpl"]
    assert labels("Nothing here, version 3.") == ([], 0.0)


def test_markup_errors():
    for markup in ("<<beginOptional>>a", "a <<endOptional>>", "<<what>> a", "<<beginOptional>>a<<endOptional>>",
                   '<<var;match=".+">> a', 'a <<var;match="[a-z]+">>', ""):
        with pytest.raises(ValueError):
            compile_templates([Template("x", markup)])


def test_long_texts_take_linear_time():
    machine = compile_templates(TEMPLATES)
    n, found, _ = scan(body("permission is hereby granted under the mit license " * 100_000), machine)
    assert n == 800_000 and len(found) == 100_000


def test_edges(spark, documents, edges):
    rows = [*edges, (20, "Under the MIT license. UNDER THE MIT-LICENSE! cc by-nc"), (21, "apache license, version 2.0")]
    found = digest(scan_licenses(documents(rows).repartition(3), TEMPLATES))
    got = sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score) for r in found.collect())
    assert len(got) == len(rows)
    assert got[-1] == (21, 5, 1, 0, 0, "apache-2", 1.0)
    assert got[-2] == (20, 11, 3, 0, 8, "cc-by-nc,mit", 1.0)
    assert [g[1] for g in got if g[0] in (1, 2, 3, 7)] == [0, 0, 0, 0]
    assert digest(scan_licenses(documents(rows).limit(0), TEMPLATES)).count() == 0


def test_base_columns_against_sql(spark):
    sql = """
    with w as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from '/root/testdata/sf0.01/documents.parquet'),
    p as (select * from (values ('mit', ['under','the','mit','license']), ('apache-2', ['apache','license','version','2']),
        ('cc-by-nc', ['cc','by','nc'])) t(label, ph)),
    hit as (select doc_id, label, i from w, p, unnest(range(len(w))) r(i) where w[i + 1:i + len(ph)] = ph)
    select w.doc_id, len(w.w) as n_words, (select count(*) from hit h where h.doc_id = w.doc_id) as n_base,
      (select min(i) from hit h where h.doc_id = w.doc_id) as first_word,
      (select max(i) from hit h where h.doc_id = w.doc_id) as last_word,
      coalesce((select string_agg(distinct label, ',' order by label) from hit h where h.doc_id = w.doc_id), '') as base_labels
    from w"""
    found = op13_template_licenses(spark, "/root/testdata/sf0.01")
    got = found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()
    with duckdb.connect() as db:
        assert sorted(tuple(r)[:6] for r in got) == sorted(db.execute(sql).fetchall())
    assert {"gpl-3"} < {label for r in got for label in r.labels.split(",")}
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
