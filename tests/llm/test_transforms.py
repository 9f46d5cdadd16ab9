"""Fill-in-middle, license scans and vector codes against brute-force versions, and on awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import codes, fim, langid, licenses, quality, urls

DOC = "doc_id long, text string, n long, form string, x string, h string, matches string"


def documents(spark, rows):
    """rows of (doc_id, text); the further columns clash with names that the operators use inside."""
    return spark.createDataFrame([(i, t, 0, "form", "x", "h", "m") for i, t in rows], DOC)


# --- 11 fill-in-middle --------------------------------------------------------


def plain_fim(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (len(units), "plain", None, None, text)
    if h[3] % 100 < 20:
        return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def awkward_texts(n=400):
    r = random.Random(3)
    pieces = ["ab", "Z", " ", "\n", "é", "漢字", "😀", "<", ">", "<P", "P>", "<P>", "S", "<M", "1", "\x00", "퟿", "￿"]
    return ["".join(r.choices(pieces, k=r.randrange(12))) for _ in range(n)]


def test_fill_in_middle(spark):
    given = list(enumerate(awkward_texts())) + [(None, "no id here"), (7, None), (7, ""), (8, "a"), (8, "a"), (9, "ab cd é " * 40_000)]
    out = fim.transform(documents(spark, given))
    got = sorted(map(repr, (tuple(r) for r in out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect())))
    expected = sorted(repr((i, t or "", *plain_fim(i, t or ""), t or "")) for i, t in given)
    assert got == expected
    assert {x[1] for x in (plain_fim(i, t or "") for i, t in given)} == {"plain", "spm", "psm"}
    assert fim.transform(documents(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 5, 7])
def test_events_over_chunks(monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    for text in awkward_texts(150):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        found = fim.Units(text)
        assert len(found) == len(units) and found.has_sentinel == bool(re.search("<[PSM]>", text))
        assert [found.place(i) for i in range(len(units) + 1)] == [len("".join(units[:i])) for i in range(len(units) + 1)]


def test_other_sentinels(spark):
    given = [(i, t) for i, t in enumerate(["a<|m|>b", *["some words, here"] * 30])]
    mine = ("<|p|>", "<|s|>", "<|m|>")
    out = fim.transform(documents(spark, given), sentinels=mine, spm_share=50)
    rows = out.withColumn("back", fim.restore(F.col("output"), F.col("form"), mine)).collect()
    assert all(r["back"] == r["text"] for r in rows) and rows[0]["form"] == "plain"
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


# --- 12 licenses --------------------------------------------------------------


def accepted(nodes):
    """All wordings of a template without ``any``."""
    out = [[]]
    for node in nodes:
        more = [[node[1]]] if node[0] == "word" else [[], *accepted(node[1])] if node[0] == "optional" else node[1]
        out = [a + b for a in out for b in more]
    return out


def test_markup_against_all_wordings():
    markup = "Used under <<beginOptional>>the <<beginOptional>>new<<endOptional>> terms of<<endOptional>> <<var;name=x;match=a|b c|b>> rules"
    wordings = {" ".join(w) for w in accepted(licenses.parse(markup))}
    automaton = licenses.Automaton((licenses.Template("x", markup),))
    r = random.Random(1)
    for _ in range(3000):
        words = r.choices("used under the new terms of a b c rules other".split(), k=r.randrange(10))
        text = " ".join(words)
        if r.random() < 0.5:
            text = r.choice(sorted(wordings))
        words = text.split()
        expected = any(" ".join(words[i:j]) in wordings for i in range(len(words)) for j in range(i + 1, len(words) + 1))
        assert bool(automaton.matches(automaton.words(text), [True])) == expected


def test_replaceable_words_and_longest_match():
    automaton = licenses.Automaton((licenses.Template("x", "by <<var;name=who;words=1-3>> inc <<beginOptional>>all rights<<endOptional>>"),))
    at = lambda text: automaton.matches(automaton.words(text), [True])
    assert at("made by the Big-Corp, Inc. All rights") == [(0, 1, 8)]
    assert at("by inc") == [] and at("by a b c d inc") == []
    assert at("by by by inc") == [(0, 0, 4)]


@pytest.mark.parametrize("markup", ["<<beginOptional>>a<<endOptional>>", "a <<endOptional>>", "<<beginOptional>>a", "a <<var;name=x>>", "<<var;name=x;words=0-2>> a"])
def test_markup_that_cannot_be_read(markup):
    with pytest.raises(ValueError):
        licenses.Automaton((licenses.Template("x", markup),))


def test_license_scan(spark, tmp_path):
    mit = re.sub("<<.*?>>", "", licenses.MIT_GRANT.replace("<<var;name=holder;words=1-20>>", "Jane Doe and others"))
    given = [
        (1, mit.upper()), (2, mit.replace("without restriction", "with restriction")), (3, "Released under the MIT License."), (4, "CC BY, cc by CC-BY NC 4.0"),
        (5, None), (6, ""), (7, "gnu general public licenses"), (8, "This work is licensed under the GNU General Public License, version 3."), (8, "x mit license"),
        (None, "mit license " * 50_000), (9, "by cc"), (10, "é" * 1_000_000), (11, "SPDX-License-Identifier: Apache-2.0"), (12, "redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ]
    documents(spark, given).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in licenses.op12_license_scan(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[2:])
    n = licenses.least_words(licenses.parse(licenses.MIT_GRANT))
    assert got[1] == [(0, None, None, "", "mit", n / (n + 4))]
    assert got[2][0][3:5] == ("", "")
    assert got[3][0][:5] == (1, 3, 3, "mit", "mit")
    assert got[4][0][:5] == (3, 0, 4, "cc-by", "cc-by,cc-by-nc-4.0")
    assert got[5] == got[6] == [(0, None, None, "", "", 0.0)]
    assert got[7][0][0] == 0
    assert sorted(x[4] for x in got[8]) == ["gpl,gpl-3.0", "mit"]
    assert got[None][0][:3] == (50_000, 0, 99_998)
    assert got[9][0][0] == 0 and got[10][0][4] == ""
    assert got[11][0][4] == "apache-2.0" and got[12][0][4] == "gpl,gpl-2.0,gpl-2.0-or-later"
    assert licenses.scan(documents(spark, [])).count() == 0


def test_words_over_chunks(monkeypatch):
    automaton = licenses.compiled(tuple(licenses.TEMPLATES))
    whole = [automaton.words(t).tolist() for t in ("mit license é gpl 3", " a ", "", "mit")]
    monkeypatch.setattr(licenses, "CHUNK", 2)
    assert [automaton.words(t).tolist() for t in ("mit license é gpl 3", " a ", "", "mit")] == whole


# --- 13 vector codes ----------------------------------------------------------


def plain_codes(vectors, parts=8, entries=16, rounds=6):
    """From scratch, in Python's whole numbers; rows of (vec_id, components, label)."""
    rows = sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            found = [near(p, c[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, i in zip(cut, found) if i == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    coded = [[near(p, c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in c) for c in coded]
    of_label = lambda k: sum(e for r, e in zip(rows, error) if r[2] == k)
    return sorted((r[0], "".join(f"{i:02x}" for _, i in c), e, of_label(r[2])) for r, c, e in zip(rows, coded, error)), digest


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, k, 0, "x", 1) for i, v, k in rows], "vec_id long, embedding array<float>, label int, uid int, place string, error int")


def test_vector_codes(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.25, r.gauss(0, 0.2)]) for _ in range(16)], r.choice([0, 1, None])) for i in range(150)]
    rows += [(200 + i, [0.25] * 16, 2) for i in range(80)] + [(3, rows[5][1], 1), (3, rows[5][1], 1), (401, None, 1), (402, [0.1] * 15 + [None], 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] * 16, None)]
    embeddings(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    kept = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], k) for i, v, k in rows if i < 400]
    expected, digest = plain_codes(kept)
    out = codes.op13_vector_codes(spark, str(tmp_path)).collect()
    assert sorted((x["vec_id"], x["code"], x["error"], x["label_error"]) for x in out) == expected
    assert {x["codebooks_sha256"] for x in out} == {digest}


def test_vector_codes_of_few_odd_and_huge_vectors(spark):
    few, books = codes.compress(embeddings(spark, [(2, [0.5, -0.5], 1), (None, [0.25], None), (1, [], 0)]))
    assert books.entries.shape == (8, 3, 1)
    assert sorted(((x["id"] is None, x["id"] or 0), x["error"]) for x in few.collect()) == [((False, 1), 0), ((False, 2), 0), ((True, 0), 0)]
    back = few.where("id = 2").select(books.decode(F.col("codes"))).first()[0]
    assert [round(x, 3) for x in back[:3]] == [0.5, -0.5, 0.0]
    huge, books = codes.compress(embeddings(spark, [(i, [3e38 * (-1) ** i, 1.0 * i], 0) for i in range(40)]))
    assert books.most > 1 << 22 and huge.count() == 40 and huge.where("error < 0").count() == 0
    nothing, books = codes.compress(embeddings(spark, [(1, None, 1)]))
    assert nothing.count() == 0 and len(books.digest()) == 64


def test_vector_codes_of_a_hot_value(spark, monkeypatch):
    """Hot and seldom values take different joins and give the same codes."""
    rows = [(i, [0.1 * (i % 7 == 3), *[0.01 * i] * 15], 0) for i in range(120)]
    of = lambda: sorted((x["id"], tuple(x["codes"]), x["error"]) for x in codes.compress(embeddings(spark, rows))[0].collect())
    first = of()
    monkeypatch.setattr(codes, "HOT", 10)
    assert of() == first
    monkeypatch.setattr(codes, "HOT", 1)
    assert of() == first


# --- repeated rows and addresses ------------------------------------------------


def test_repeated_rows_teach_once(spark, monkeypatch):
    texts = [("en", "the cat and the dog of the house"), ("fr", "le chat et le chien de la maison")]
    docs = spark.createDataFrame([(i, *texts[i % 2]) for i in range(400)], "doc_id long, lang string, text string")
    sizes = []
    made = langid.Model.__init__
    monkeypatch.setattr(langid.Model, "__init__", lambda self, x, langs: sizes.append(len(x)) or made(self, x, langs))
    assert langid.fit(docs, F.lit(True), sample=500) is not None and sizes == [2]
    rows = [(1, "a good text here", 16), (1, "another text", 12)] * 200 + [(2, None, 0), (3, "x" * 50, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    seen = []
    learn = quality.FactorisationMachine.fit
    monkeypatch.setattr(quality.FactorisationMachine, "fit", lambda self, x, y: seen.append(len(x)) or learn(self, x, y))
    assert quality.fit(docs, labels, F.lit(True)) is not None and seen == [2]


def test_addresses_share_no_domain(spark):
    given = ["1.2.3.4", "9.9.3.4:80", "u@1.2.3.4", "[::1]:8080", "a.b.co.uk", "3.4"]
    rows = spark.createDataFrame([(h,) for h in given], "h string").select(urls.domain_of(F.col("h")), urls.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [("1.2.3.4", "1.2.3.4"), ("9.9.3.4", "9.9.3.4"), ("1.2.3.4", "1.2.3.4"), ("[::1]", "[::1]"), ("b.co.uk", "co.uk"), ("3.4", "4")]
