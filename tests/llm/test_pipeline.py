"""The pipeline against plain versions of its stages."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillsift.llm import langid, mixing, pieces, registry, secrets


def rows():
    r = random.Random(0)
    vocabulary = {"en": "the of and to in that it was for with this from", "fr": "le la et les des en un une que dans pour sur"}
    out = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        out.append((i, " ".join(r.choices(vocabulary[lang].split(), k=60)), lang, ("s0", "s1", None)[i % 3]))
    out[7] = (7, out[3][1], "en", "s0")
    out[8] = (8, "12 34 !!", "fr", "s0")
    out[9] = (9, None, "en", "s0")
    out[10] = (10, out[10][1] + " token=abcdefgh12", None, "s1")
    return out


def test_stages(spark, tmp_path):
    frame = spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    given = {i: t for i, t, _, _ in rows()}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)))
    known, single, clean, mixed, coded = seen[1:]
    assert all(d.columns == columns for d in (known, single, clean, mixed))
    assert {r["doc_id"] for r in known.collect()} == set(given) - {8, 9}
    assert {r["lang"] for r in known.where("doc_id = 10").collect()} == {"en"}
    assert {r["doc_id"] for r in single.collect()} == set(given) - {7, 8, 9}
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert text[10][0].endswith(" [SECRET]") and text[10][1] == len(text[10][0])
    assert all(t[0] == given[i] for i, t in text.items() if i != 10)
    repeats = {r["doc_id"]: r["repeats"] for r in mixing.mix(clean).collect()}
    found = coded.collect()
    v = pieces.Vocabulary.load(pieces.MODEL)
    assert len(found) == sum(repeats.values()) == mixed.count()
    for r in found:
        assert v.decode(np.array(r["ids"], dtype="<u4").tobytes()) == text[r["doc_id"]][0] and r["n_pieces"] == len(r["ids"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_pieces"]) for r in whole) == sorted((r["doc_id"], r["n_pieces"]) for r in found)


def corpus(spark, given):
    return spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in given], "doc_id long, text string, lang string, source string, n_chars long")


def test_language_decisions_take_effect(spark, tmp_path, monkeypatch):
    given = rows()
    given[20] = (20, given[20][1], "fr", "s0")  # English words
    docs = corpus(spark, given)
    lang = {r["doc_id"]: r["lang"] for r in corpus_pipeline.known_language(spark, docs, str(tmp_path)).collect()}
    assert lang[20] == "en" and lang[21] == "fr" and set(lang) == {i for i, *_ in given} - {8, 9}
    model = langid.fit(docs, F.lit(True))
    score = {r["id"]: r["score"] for r in langid.identify(docs, model).collect()}
    middle = sorted(score.values())[30]
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", middle)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, s in score.items() if s >= middle}


def test_an_unlabelled_corpus_is_kept(spark, tmp_path):
    docs = corpus(spark, [(i, t, None, s) for i, t, _, s in rows()])
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.known_language(spark, docs, str(tmp_path)).collect()}
    assert set(got) == set(range(60)) - {8, 9} and set(got.values()) == {None}
    assert corpus_pipeline.known_language(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_whole_pipeline_of_empty_and_unlabelled_tables(spark, tmp_path):
    """Nothing in, nothing out; without labels only letterless rows and copies go; awkward rows pass."""
    given = [(i, t, None, s) for i, t, _, s in rows()] + [(None, "the of and that was", None, None), (70, "the of\n" * 40_000, None, "s0"), (71, "the of\n" * 40_000, None, "s0")]
    for name, frame in (("none", corpus(spark, given).limit(0)), ("unlabelled", corpus(spark, given))):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert all(r["exact"] for r in got)
        kept = {r["doc_id"] for r in got}
        assert kept == set() if name == "none" else {8, 9, 7, 71}.isdisjoint(kept) and kept <= {i for i, *_ in given}


def test_encoding_checks_the_round_trip(spark, monkeypatch):
    texts = ["The  solar cells.\n", " a\u2581b \u4e2d\u6587 \U0001f600", "", None]
    docs = corpus(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in corpus_pipeline.encoded(spark, docs, "").collect()}
    assert all(r["exact"] for r in got.values()) and got[2]["n_pieces"] == got[3]["n_pieces"] == 0

    load = pieces.Vocabulary.load

    def lossy(path):
        v = load(path)
        v.raw = [b.replace(b"s", b"z") for b in v.raw]
        return v

    monkeypatch.setattr(pieces.Vocabulary, "load", lossy)
    got = {r["doc_id"]: r["exact"] for r in corpus_pipeline.encoded(spark, docs, "").collect()}
    assert got == {0: False, 1: True, 2: True, 3: True}


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and secrets.KINDS[:3] == ("assign", "access", "hex")
