"""Associations, impact blocks, learned lemmas, tagger, segmenter and stored vectors against brute-force versions."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.operators import associations, clusters, impacts, keyword, lemmas, segment, tagger, text, vectors, words


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def corpus(n=120, seed=0, vocabulary=40):
    r = random.Random(seed)
    return [(i, " ".join(f"t{min(int(r.expovariate(0.12)), vocabulary)}" for _ in range(r.randrange(1, 60)))) for i in range(n)]


# --- associations -------------------------------------------------------------


def plain_associates(sentences, keywords, n, least, window=associations.WINDOW):
    counts = Counter()
    for s in sentences:
        t = s.split()
        for i in range(len(t)):
            for j in range(i + 1, min(i + window, len(t) - 1) + 1):
                counts[t[i], t[j]] += 1
                counts[t[j], t[i]] += 1
    total = Counter()
    for (a, _), c in counts.items():
        total[a] += c
    whole = sum(total.values())
    row = defaultdict(dict)
    for (a, b), c in counts.items():
        w = math.log(c * whole / (total[a] * total[b]))
        if w > 0:
            row[a][b] = w
    length = {a: math.sqrt(sum(w * w for w in r.values())) for a, r in row.items()}
    out = []
    for q in sorted(set(keywords) & set(row)):
        cosines = sorted((-round(sum(w * row[t].get(c, 0) for c, w in row[q].items()) / (length[q] * length[t]), 6), t) for t in row if t not in keywords and total[t] >= least and set(row[t]) & set(row[q]))
        out += [(q, i + 1, t, -c) for i, (c, t) in enumerate(cosines[:n])]
    return out


def test_associates(spark, tmp_path):
    given = corpus()
    sents = spark.createDataFrame([(t,) for _, t in given] + [("",), (None,), ("one1",)], "sentence string")
    tables = associations.build(sents, str(tmp_path / "a"))
    asked = ["t0", "t3", "t17", "unknown"]
    expected = plain_associates([t for _, t in given], asked, 4, 10)
    assert rows(associations.associates(tables, asked), "term", "rank") == expected
    assert rows(associations.associates(tables, asked, most_terms=10**6), "term", "rank") == expected
    assert associations.associates(tables, asked, most_terms=0).count() == 0
    with pytest.raises(FileNotFoundError):
        associations.load(spark, str(tmp_path / "none"))
    empty = associations.build(sents.limit(0), str(tmp_path / "b"))
    assert associations.associates(empty, asked).count() == 0


def test_expanded_keywords(spark):
    kw = keyword.keyword_table(spark, ["b", "a", "b"], raw=True)
    found = spark.createDataFrame([("a", 1, "x", 0.5), ("b", 1, "y", 0.5), ("b", 2, "x", 0.4), ("b", 3, "a", 0.3)], "term string, rank int, associate string, cosine double")
    assert rows(associations.expanded(kw, found), "ord") == [("b", 0, 2), ("a", 1, 1), ("y", 2, 1), ("x", 3, 1)]
    assert rows(associations.expanded(kw, found.limit(0)), "ord") == [("b", 0, 2), ("a", 1, 1)]


# --- impact blocks ------------------------------------------------------------


@pytest.mark.parametrize(("waves", "k"), [(impacts.WAVES, 10), ((1, 2), 5), ((), 3), ((1,), 1000)])
def test_impacts_give_the_ranking_of_all_documents(spark, tmp_path, waves, k):
    docs = spark.createDataFrame(corpus(400, seed=4) + [(1000, "none"), (1001, "")], "doc_id long, text string")
    tables = impacts.build(docs.select("doc_id", text.token_array(F.col("text")).alias("terms")), ["doc_id"], str(tmp_path / "i"), block=8)
    asked = ["t1", "t30", "t38", "absent"]
    whole = rows(keyword.bm25_documents(docs, keyword.keyword_table(spark, asked, raw=True)), F.col("score").desc(), "doc_id")
    found, seen = impacts.top(tables, asked, k, waves)
    assert rows(found.select("key.doc_id", "score"), F.col("score").desc(), "doc_id") == whole[:k]
    assert [r[0] for r in rows(found.select("rank"), "rank")] == list(range(1, min(k, len(whole)) + 1))
    assert rows(impacts.scores(tables, asked).select("key.doc_id", "score"), F.col("score").desc(), "doc_id") == whole
    assert seen["read"] <= seen["blocks"] and (k > 5 or not waves or seen["read"] < seen["blocks"])
    bound = dict(rows(impacts.bounds(tables, asked), "block"))
    block = dict(rows(tables["units"].select("key.doc_id", "block"), "doc_id"))
    assert all(score <= bound[block[i]] + 1e-4 for i, score in whole)


def test_impacts_edges(spark, tmp_path):
    units = spark.createDataFrame([(1, 0, ["a", "b", "a"]), (1, 1, []), (2, 0, ["a"])], "doc_id long, sent_id int, terms array<string>")
    tables = impacts.build(units, ["doc_id", "sent_id"], str(tmp_path / "s"))
    found, _ = impacts.top(tables, ["a"], 5)
    assert {tuple(r) for r in found.select("key.doc_id", "key.sent_id").collect()} == {(1, 0), (2, 0)}
    assert impacts.top(tables, ["z"], 5)[0].count() == 0
    nothing = impacts.build(units.limit(0), ["doc_id"], str(tmp_path / "n"))
    assert impacts.top(nothing, ["a"], 5)[0].count() == 0
    plan = impacts.scores(tables, ["a"], impacts._within([1, 2, 9]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(term" in plan or "EqualTo(term" in plan
    assert "sentence" not in plan and "text" not in plan


def test_ranges_cover_blocks(spark):
    r = random.Random(0)
    for n in (1, 2, 16, 17, 60):
        blocks = sorted({r.randrange(1000) for _ in range(n)})
        within = impacts._within(blocks)
        kept = {x[0] for x in spark.range(1000).withColumnRenamed("id", "block").where(within).collect()}
        assert set(blocks) <= kept and (n > impacts.RANGES or kept == set(blocks))


# --- lemmas -------------------------------------------------------------------


def test_learned_lemmas(spark):
    scripts, words = lemmas.default_tables(spark)
    edits = lemmas.collected(scripts, words)
    cases = {"walks": "walk", "walking": "walk", "walked": "walk", "making": "make", "carries": "carry", "stopped": "stop", "bigger": "big", "happiest": "happy", "cities": "city", "boxes": "box",
             "children": "child", "better": "good", "was": "be", "class": "class", "bus": "bus", "king": "king", "this": "this", "s": "s", "ed": "ed", "": ""}
    assert {w: edits.lemma(w) for w in cases} == cases
    assert edits.lemma("rewalking") == "rewalk" and edits.lemma("raking") == "rake"  # unseen words
    r = random.Random(1)
    many = sorted({"".join(r.choices("aeisngdtkyr", k=r.randrange(1, 12))) for _ in range(2000)} | set(cases) - {""} | {f for f, _ in lemmas.regular_pairs()})
    table = dict(rows(lemmas.lemma_table(spark.createDataFrame([(w,) for w in many * 2], "word string"), scripts, words), "word"))
    assert table == {w: edits.lemma(w) for w in many}
    irregular = dict(lemmas.irregular_pairs())
    first = {f: lemma for f, lemma in reversed(lemmas.regular_pairs())} | irregular
    assert {f: edits.lemma(f) for f in first} == first
    alone = lemmas.Edits(edits.scripts, {})
    assert sum(alone.lemma(f) == first[f] for f in first if f not in irregular) / len(first) > 0.75  # by suffixes alone
    plugin = lemmas.lemmatizer(edits)
    got = spark.createDataFrame([("The Cats walked, happier!",), (None,), ("",)], "t string").select(plugin(F.col("t"))).collect()
    assert [g[0] for g in got] == ["the cat walk , happy !", None, ""]


def test_learn_by_brute_force(spark):
    r = random.Random(3)
    pairs = sorted({("".join(r.choices("abs", k=r.randrange(1, 5))) + end, "".join(r.choices("ab", k=2))) for end in ("s", "es", "") for _ in range(60)})
    counts = defaultdict(Counter)
    for form, lemma in pairs:
        p = len(next(x for x in (form[:i] for i in range(len(form), -1, -1)) if lemma.startswith(x)))
        for n in range(max(1, len(form) - p), min(3, len(form) - 1) + 1):
            counts[form[-n:]][len(form) - p, lemma[p:]] += 1
    expected = sorted((s, *min(c, key=lambda x: (-c[x], x))) for s, c in counts.items() if sum(c.values()) >= 2)
    assert rows(lemmas.learn(spark.createDataFrame(pairs + pairs[:5], "form string, lemma string"), longest=3), "suffix") == expected


# --- tagger -------------------------------------------------------------------


def score_of(model, symbols, path):
    out, before = 0.0, len(tagger.TAGS)
    for s, t in zip(symbols, path):
        out += model.follows[before, t] + model.emits[t, s]
        before = t
    return out


def test_best_paths_by_brute_force():
    r = random.Random(2)
    model = tagger.start_model()
    sentences = [np.array([r.randrange(len(tagger.CLASSES)) for _ in range(r.randrange(0, 5))]) for _ in range(40)]
    for symbols, path in zip(sentences, tagger.paths(model, sentences)):
        best = max((score_of(model, symbols, p) for p in itertools.product(range(len(tagger.TAGS)), repeat=len(symbols))), default=0.0)
        assert len(path) == len(symbols) and score_of(model, symbols, path) == pytest.approx(best)


def test_long_sentences_go_through_in_blocks(monkeypatch):
    r = random.Random(3)
    model = tagger.start_model()
    sentences = [np.array([r.randrange(len(tagger.CLASSES)) for _ in range(r.choice([0, 1, 3, 40, 900]))]) for _ in range(60)]
    alone = [tagger.paths(model, [s])[0].tolist() for s in sentences]
    assert [p.tolist() for p in tagger.paths(model, sentences)] == alone
    monkeypatch.setattr(tagger, "CELLS", 50)
    assert [p.tolist() for p in tagger.paths(model, sentences)] == alone


def test_valid_sentences(spark):
    given = ["the dog is in the house .", "the red house .", "of the in .", "she walked to the city .", "walked .", "", "42 !", None, "Der Mann ist alt ."]
    df = spark.createDataFrame(list(enumerate(given)), "id int, s string")
    seen = df.select("id", tagger.classes(F.col("s")).alias("symbols"))
    assert [r[0] for r in rows(seen.where("id < 7").select("symbols", "id"), "id")] == [[tagger.word_class(w) for w in s.split()] for s in given[:7]]
    found = tagger.tagged(seen, tagger.start_model(), "id")
    assert {r["id"]: r["valid"] for r in found.collect()} == {0: True, 1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False, 8: True}
    assert tagger.tagged(seen.limit(0), tagger.fit(seen.limit(0)), "id").count() == 0


def test_training_counts_every_row(spark):
    """A round by hand on all sentences gives the same model, however rows are dealt."""
    r = random.Random(5)
    sentences = [[r.randrange(len(tagger.CLASSES)) for _ in range(r.randrange(0, 9))] for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in sentences], "symbols array<int>")
    start = tagger.start_model()
    follows, emits = np.zeros((len(tagger.TAGS) + 1, len(tagger.TAGS))), np.zeros((len(tagger.TAGS), len(tagger.CLASSES)))
    for s, path in zip(sentences, tagger.paths(start, [np.array(s, dtype=int) for s in sentences])):
        for a, b in zip([len(tagger.TAGS), *path], path):
            follows[a, b] += 1
        for t, c in zip(path, s):
            emits[t, c] += 1
    expected = tagger._model(follows, emits)
    for parts in (1, 7):
        got = tagger.fit(df.repartition(parts), rounds=1)
        assert np.allclose(got.follows, expected.follows) and np.allclose(got.emits, expected.emits)


def test_splitter_gathers_until_valid(spark):
    docs = spark.createDataFrame([(1, "the red house . she walked home ! of . the dog is old . rest"), (2, None), (3, ""), (4, "of the .")], "doc_id long, text string")
    found = text.sentences(docs, lemmatizer=lambda c: c, splitter=tagger.splitter(tagger.start_model()))
    assert rows(found, "doc_id", "sent_id") == [(1, 0, "the red house . she walked home !"), (1, 1, "of . the dog is old . rest")]


# --- segmenter ----------------------------------------------------------------


def test_best_words_by_brute_force():
    r = random.Random(7)
    words = sorted({"".join(r.choices("ab漢", k=r.randrange(1, 4))) for _ in range(14)})
    made = segment.Segmenter([(w, r.randrange(1, 50)) for w in words])
    weight = {w: math.log(n) - made.total for w, n in made.words}

    def value(parts):
        return sum(weight.get(p, made.unknown if len(p) == 1 else -math.inf) for p in parts)

    for _ in range(300):
        run = "".join(r.choices("ab漢x", k=r.randrange(1, 9)))
        cuts = ([run[a:b] for a, b in itertools.pairwise([0, *c, len(run)])] for n in range(len(run)) for c in itertools.combinations(range(1, len(run)), n))
        assert "".join(made.best(run)) == run and value(made.best(run)) == pytest.approx(max(map(value, cuts)))


def test_keywords_of_unspaced_text(spark):
    docs = spark.createDataFrame([(1, "北京 大学 在 北京"), (2, "solar cells solar power " * 3), (3, None), (4, "")], "doc_id long, text string")
    words = [("北京", 5), ("大学", 3), ("北", 1), ("solar", 9), ("cells", 4), ("power", 4)]
    unspaced = docs.select("doc_id", F.replace("text", F.lit(" ")).alias("text"))
    found = keyword.extract_keywords(unspaced, 2, segment.segmenter(words))
    assert rows(found, "doc_id") == [(1, "北京 在"), (2, "solar cells")]
    assert segment.dictionary(docs, most=2) == [("solar", 6), ("cells", 3)]
    long = segment.Segmenter([("ab", 3), ("a" * 30, 2)])
    assert "".join(long.best("a" * 200_000)) == "a" * 200_000


# --- stored vectors -----------------------------------------------------------


def test_two_stage_over_stored_vectors(spark, tmp_path):
    r = random.Random(9)
    given = [(i % 30, i, [r.gauss(0, 1) for _ in range(4)], f"s{i}") for i in range(300)]
    df = spark.createDataFrame(given, "doc long, id long, vector array<double>, sentence string")
    vectors.write_sentences(df, str(tmp_path), buckets=8)
    stored = vectors.load_sentences(spark, str(tmp_path), buckets=8)
    query = spark.createDataFrame([(0, [1.0, 0.5, 0.0, -1.0])], "query_id int, q array<double>")
    reps = vectors.rep_mean(df)
    plain = rows(vectors.two_stage(df, reps, query, 2, 5), "rank")
    found = vectors.two_stage(stored, reps, query, 2, 5, carry=("sentence",))
    assert rows(found.drop("sentence"), "rank") == plain
    assert all(r["sentence"] == f"s{r['id']}" for r in found.collect())
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    with pytest.raises(FileNotFoundError):
        vectors.load_sentences(spark, str(tmp_path / "none"))


# --- dense search -------------------------------------------------------------


@pytest.mark.parametrize(("by", "ascending"), [(vectors.cosine, False), (vectors.dot, False), (vectors.l2_squared, True)])
def test_matrix_products_give_the_exact_ranking(spark, monkeypatch, by, ascending):
    r = random.Random(4)
    pool = [[r.choice([0.0, 0.5, -1.0, 1 / 3]) for _ in range(3)] for _ in range(25)]
    given = [(i, r.choice(pool)) for i in r.sample(range(10_000), 600)] + [(-1, [0.0, 0.0, 0.0])]
    if by is not vectors.l2_squared:
        given += [(20_000, None), (20_001, [1.0]), (20_002, [float("nan"), 1.0, 1.0]), (20_003, [])]
    df = spark.createDataFrame(given, "id long, vector array<double>").repartition(5)
    query = spark.createDataFrame([(0, [1.0, 0.5, -0.2]), (1, [0.0, 0.0, 0.0]), (2, pool[0])], "query_id int, q array<double>")
    monkeypatch.setattr(vectors.dense, "CELLS", 100)
    for k in (1, 7, 1000):
        found = rows(vectors.nearest(df, query, k, by, ascending).select("query_id", "rank", "id", "score"), "query_id", "rank")
        with monkeypatch.context() as m:
            m.setattr(vectors.dense, "METRICS", ())
            plain = rows(vectors.nearest(df, query, k, by, ascending).select("query_id", "rank", "id", "score"), "query_id", "rank")
        assert repr(found) == repr(plain)


def test_equal_vectors_take_k_places():
    found = vectors.dense.Nearest(np.array([[1.0, 0.0], [0.6, 0.8]]), 3, "cosine")
    for at in range(0, 100_000, 10_000):
        found.add(np.arange(at, at + 10_000)[::-1].copy(), np.tile([[0.3, 0.4]], (10_000, 1)))
    assert len(found.held[0]) == 6 and sorted(found.held[1].tolist()) == [0, 0, 1, 1, 2, 2]


def test_questions_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "id int, vector array<float>")
    query = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "query_id int, q array<double>")
    whole = rows(vectors.nearest(df, query, 4), "query_id", "rank")
    monkeypatch.setattr(vectors, "QUESTIONS", 2)
    assert rows(vectors.nearest(df, query, 4), "query_id", "rank") == whole and len(whole) == 36


# --- many words ---------------------------------------------------------------


def test_many_words_equal_the_expression(spark, monkeypatch):
    r = random.Random(6)
    listed = ["a", "ab", "a.b", ".x", "né", "é", "漢字", "a b", "b_", "1"]
    texts = ["".join(r.choices(["a", "b", ".", "x", " ", "é", "n", "漢字", "_", "1", "-", "\n", "e\u0301"], k=r.randrange(14))) for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    expected = rows(df.select("i", keyword.regex_count(F.col("t"), listed)), "i")
    assert sum(n or 0 for _, n in expected) > 500
    monkeypatch.setattr(keyword, "WRITTEN", 0)
    assert rows(df.select("i", keyword.regex_count(F.col("t"), listed)), "i") == expected


def test_ten_thousand_words(spark):
    listed = [f"w{i}" for i in range(10_000)]
    df = spark.createDataFrame([("w1 w12 xw3 w9999, w10000 w1",)], "t string")
    assert df.select(keyword.regex_count(F.col("t"), listed)).first()[0] == 4
    known = [(t, i, 1 + i % 2) for i, t in enumerate(listed)]
    assert df.select(keyword.matched(F.array(F.lit("w1"), F.lit("w2"), F.lit("zz")), known)).first()[0] == 3
    assert df.select(keyword.matched(F.array(F.lit("w1"), F.lit("w2"), F.lit("zz")), known[:60])).first()[0] == 3


# --- kept tables and files ----------------------------------------------------


def test_tables_are_kept_by_the_list_of_files(spark, tmp_path):
    import os

    from quillsift.sources import files, shared

    path = tmp_path / "t"
    spark.range(10).coalesce(1).write.parquet(str(path))
    (part,) = [p for p in path.iterdir() if p.name.startswith("part-")]
    before = shared.state(spark, str(path))
    assert shared.state(spark, str(path)) == before and before[0] == 1
    os.utime(part, (1, 1))  # the folder's time and the size stay
    assert shared.state(spark, str(path)) != before
    assert shared.state(spark, str(part))[0] == 1
    df = spark.createDataFrame([("pdf_7", "a\nb \"c\""), ("x", None)], "name string, text string")
    files.write_lines(df, str(tmp_path / "lines"))
    assert rows(files.read_lines(spark, str(tmp_path / "lines")), "doc_id") == [(7, "a\nb \"c\""), (2**63 - 1, None)]


# --- topics -------------------------------------------------------------------


def plain_lloyd(units, centres, steps):
    """Spherical steps over dense rows: (centres, labels, cost)."""
    x = np.array(units)
    for _ in range(steps + 1):
        near = (x @ centres.T / clusters.UNIT).round(9)
        labels = near.argmax(axis=1)
        moved = np.stack([clusters._unit(x[labels == c].sum(axis=0)) if (labels == c).any() else centres[c] for c in range(len(centres))])
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres, labels, (1 - near.max(axis=1)).sum()


def test_starts_by_brute_force(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(r.choices([f"{'xyz'[i % 3]}{j}" for j in range(6)] + ["common"], k=12))) for i in range(90)] + [(90, ""), (91, None), (92, "the of")], "doc_id long, text string")
    units = clusters.unit_vectors(docs, "doc_id", features=64).cache()
    held = {x["doc_id"]: clusters._dense(x["at"], x["x"], 64) for x in units.collect()}
    assert len(held) == 93 and not held[90].any() and all(abs(np.linalg.norm(v) / clusters.UNIT - 1) < 1e-5 for i, v in held.items() if i < 90)
    first = clusters.seed(units, 3, "doc_id", starts=4, features=64)
    assert first.shape == (4, 3, 64) and np.allclose(np.linalg.norm(first, axis=2), 1)
    assert np.array_equal(first, clusters.seed(units.repartition(5), 3, "doc_id", starts=4, features=64))
    rows_ = [v for i, v in sorted(held.items()) if i < 90]
    plain = [plain_lloyd(rows_, c, 20) for c in first]
    found = clusters.fit(units.repartition(3), 3, "doc_id", features=64, first=first)
    assert found.costs == pytest.approx([p[2] for p in plain], abs=1e-3)
    assert found.best == int(np.argmin(np.round([p[2] for p in plain], 3))) or min(found.costs) == pytest.approx(found.costs[found.best], abs=1e-3)
    assert np.allclose(found.centres, plain[found.best][0], atol=1e-9)
    labels = {x["doc_id"]: (x["topic"], x["similarity"]) for x in clusters.assign(units, found, "doc_id").collect()}
    assert [labels[i][0] for i in range(90)] == plain[found.best][1].tolist() and labels[90] == labels[91] == labels[92] == (0, 0.0)
    assert len({tuple(labels[i][0] for i in range(c, 90, 3)) for c in range(3)}) == 3  # each vocabulary is a topic


def test_topics_of_few_units(spark):
    docs = spark.createDataFrame([(1, "one word"), (2, "one word"), (3, "")], "doc_id long, text string")
    found, model = clusters.topic_model(docs, "doc_id", 5, starts=2)
    assert len({r["topic"] for r in found.where("doc_id < 3").collect()}) == 1 and found.count() == 3 and max(model.costs) < 1e-3
    assert clusters.topic_model(docs.limit(0), "doc_id", 2, starts=2)[0].count() == 0
