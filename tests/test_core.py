"""Hand-derived cases of the core operators."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillsift.functions.plugins import embedder_plugin, splitter_plugin, text_plugin, validator_plugin
from quillsift.operators import clusters, context, keyword, text, topics, vectors
from quillsift.plans import oracles, registry
from quillsift.sources import files, index
from quillsift.streaming import ingest


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, value, expression, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expression(F.col("x"))).first()[0]


def posts_of(spark, docs):
    return spark.createDataFrame([(d, t, s) for d, index in docs.items() for t, ids in index.items() for s in ids], "doc_id long, term string, sent_id int")


DOCS = {0: {"alpha": [0, 1, 4], "beta": [1]}, 1: {"alpha": list(range(20))}}


def test_line_cleaning(spark):
    lines = ["Hello  World", "", "123", "https://a.com/x y", "See https://a.com", "___", "***", "* *", "12 3", "HTTPS://A.COM", "https://localhost/x"]
    assert one(spark, "\n".join(lines), text.clean_text) == "hello world  see https://a.com ___ * * 12 3 https://a.com https://localhost/x"


def test_token_rule(spark):
    got = one(spark, "covid-19 a1 e-mail AB 67% ### a x- 1st café -- word,", text.token_array)
    assert got == ["covid-19", "a1", "e-mail", "ab"]


def test_keyword_scores(spark):
    posts = posts_of(spark, DOCS)
    kw = keyword.keyword_table(spark, ["alpha", "beta", "gamma"], raw=True)
    assert rows(keyword.top_documents(keyword.doc_scores(posts, kw), 5).select("rank", "doc_id", "points", "score"), "rank") == [(1, 0, 36, 1.8), (2, 1, 36, 1.8)]
    counts = rows(keyword.sentence_counts(posts.where("doc_id = 0"), kw), F.col("hits").desc(), "sent_id")
    assert [c[1:] for c in counts] == [(1, 2), (0, 1), (4, 1)]
    assert rows(keyword.missing_keywords(kw, posts), "term") == [("gamma",)]
    twice = keyword.doc_scores(posts.where("doc_id = 0"), keyword.keyword_table(spark, ["alpha", "alpha"], raw=True)).first()
    assert (twice["coverage"], twice["total"], twice["score"]) == (1, 6, 1.1)


def test_intersection(spark):
    posts = posts_of(spark, DOCS)
    assert rows(keyword.intersection(posts), "doc_id", "sent_id") == [(0, 1), *[(1, i) for i in range(20)]]
    assert rows(keyword.intersection(posts.where("term = 'zeta'")), "doc_id") == []


@pytest.mark.parametrize(("lengths", "initial", "kept"), [([4, 6, 2, 2], 0, 2), ([9, 3, 1], 0, 2), ([4], 11, 0)])
def test_packing(spark, lengths, initial, kept):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)], "i int, sentence string")
    assert context.pack(df, [F.col("i")], limit=10, initial=initial).count() == kept


def test_packing_equals_greedy_loop(spark):
    lengths = [7, 1, 9, 30, 2, 2, 8, 14, 3, 40, 5]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)], "i int, sentence string")
    for limit in (0, 10, 48, 200):
        used, kept = 0, 0
        for n in lengths:
            if used > limit:
                break
            used, kept = used + n + 1, kept + 1
        assert context.pack(df, [F.col("i")], limit=limit).count() == kept


def test_regex_count(spark):
    count = lambda s, words: one(spark, s, lambda c: keyword.regex_count(c, words))
    assert count("alpha beta alphabet alpha", ["alpha"]) == 2
    assert count("Alpha", ["alpha"]) == 0
    assert count("axb", ["a.b"]) == 0
    assert count("alpha", []) == 0


def test_reply_parsing(spark):
    df = spark.createDataFrame([(0, "[a, b] x [c]"), (1, "[a,b] [c]"), (2, "[a]"), (3, "[a] [b] [c]")], "i int, r string")
    a, b = keyword.parse_reply(F.col("r"))
    assert rows(df.select("i", a, b), "i") == [(0, ["a", "b"], ["c"]), (1, ["a,b"], ["c"]), (2, [], []), (3, [], [])]


def test_file_number(spark):
    df = spark.createDataFrame([("embeddings12",), ("processed_file_3",), ("pdf_3_v2",), ("faiss_sentences",)], "s string")
    assert [r[0] for r in df.select(text.file_number(F.col("s"))).collect()] == [12, 3, 3, 2**63 - 1]


def test_representatives_are_means(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "doc long, vector array<double>")
    for rep in (vectors.rep_mean, vectors.rep_adaptive_pca, vectors.rep_pca_kmeans):
        got = {r["doc"]: r["rep"] for r in rep(df).collect()}
        assert got[0] == pytest.approx([2, 2]) and got[1] == pytest.approx([5, 6])


def test_elbow(spark):
    assert vectors.elbow([100, 60, 50, 45]) == 3 and vectors.elbow([7.0]) == 2
    df = spark.createDataFrame([(0, k, float(s)) for k, s in zip(range(2, 6), (100, 60, 50, 45))] + [(1, 2, 5.0)], "doc int, k int, sse double")
    assert rows(vectors.elbow_k(df), "doc") == [(0, 3), (1, 2)]


def test_sentence_merge(spark):
    assert one(spark, "a b . c . d e f . g", lambda c: text.sentence_array(c, 2)) == ["a b .", "c . d e f . g"]
    assert one(spark, "a .", lambda c: text.sentence_array(c, 2)) == []
    assert one(spark, "", text.sentence_array) == []


def test_nearest(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 2.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, q array<double>")
    assert rows(vectors.nearest(df, q, 5).select("rank", "id", "score"), "rank") == [(1, 0, 1.0), (2, 1, 0.0), (3, 2, 0.0)]
    assert rows(vectors.nearest(df, q, 2, vectors.l2_squared, ascending=True).select("id", "score"), "id") == [(0, 0.0), (1, 1.0)]
    with pytest.raises(Exception, match="dimension"):
        vectors.nearest(df, spark.createDataFrame([(9, [1.0])], "query_id long, q array<double>"), 1, vectors.l2_squared).collect()


def test_postings_merge(spark):
    parts = spark.createDataFrame([(0, "a", [0, 2]), (0, "a", [2, 1]), (0, "b", [0])], "doc_id long, term string, postings array<int>")
    assert rows(keyword.merge_postings(parts), "term") == [(0, "a", [0, 1, 2]), (0, "b", [0])]


def test_document_keywords(spark):
    docs = spark.createDataFrame([(0, "bb aa bb cc aa dd")], "doc_id long, text string")
    assert keyword.extract_keywords(docs, 2).first()["keywords"] == "aa bb"


def test_lemmas_and_chunks(spark):
    assert one(spark, "Cities, boxes glass!", text.lemmatize) == "City , box glass !"
    assert one(spark, "abcde", lambda c: text.chunk_array(c, 2)) == ["ab", "cd", "e"]
    assert one(spark, "", text.chunk_array) == []


def test_topics(spark):
    docs = spark.createDataFrame([(0, "red apple red"), (1, "blue sky"), (2, "the of")], "doc_id long, text string")
    weights = topics.tfidf(docs, "doc_id").toPandas()
    assert (weights.groupby("doc_id").w.apply(lambda w: (w**2).sum()) - 1).abs().max() < 1e-9
    vocab = topics.vocabulary(docs, topics.unit_terms(docs, "doc_id"))
    cents = topics.centroids(topics.tfidf(docs, "doc_id"), spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, topic string"), "doc_id")
    sims = topics.match(spark.createDataFrame([(0, "an apple")], "query_id int, text string"), vocab, cents)
    assert [r["topic"] for r in sims.collect()] == ["a"]


def test_plugins(spark):
    df = spark.createDataFrame([("Ab",), (None,)], "s string")
    assert [r[0] for r in df.select(text_plugin(lambda xs: [x.upper() for x in xs])("s")).collect()] == ["AB", None]
    assert [r[0] for r in df.select(validator_plugin(lambda xs: [len(x) > 1 for x in xs])("s")).collect()] == [True, False]
    assert [r[0] for r in df.select(embedder_plugin(lambda: lambda xs: [[len(x)] for x in xs], 1)("s")).collect()] == [[2.0], [0.0]]


def test_files(spark, tmp_path):
    (tmp_path / "pdf_7.txt").write_text("one two")
    (tmp_path / "page_3.html").write_text("<p>a</p><script>x</p></script><div> b &amp; c</div>")
    (tmp_path / "index_5.json").write_text('{"a": [0, 2]}')
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path / "*.txt")).collect()] == [(7, "one two")]
    assert rows(files.read_pages(spark, str(tmp_path / "*.html")), "line_no") == [(3, 0, 0, "a"), (3, 0, 1, "b & c")]
    assert rows(files.read_pages(spark, str(tmp_path / "*.html"), lambda raw: ["p1", "p2\nx"]), "page", "line_no") == [(3, 0, 0, "p1"), (3, 1, 0, "p2"), (3, 1, 1, "x")]
    index = files.read_index_json(spark, str(tmp_path / "*.json"))
    assert [tuple(r) for r in index.collect()] == [(5, "a", [0, 2])]
    assert files.index_json(index).first()["json"] == '{"a":[0,2]}'
    assert rows(files.unpaired(index, spark.createDataFrame([(5,), (6,)], "doc_id long")), "doc_id") == [(6,)]
    files.write_table(index, str(tmp_path / "out"), "term")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_streaming_upsert(spark, tmp_path):
    source = tmp_path / "in"
    frame = lambda doc, t: spark.createDataFrame([(doc, t)], "doc_id long, text string")
    frame(1, "Old words stand here.").write.parquet(str(source / "a"))
    schema = "doc_id long, text string"
    from pyspark.sql.types import _parse_datatype_string

    def run():
        stream = ingest.stream_files(spark, str(source / "*"), _parse_datatype_string(schema))
        ingest.ingest_documents(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    run()
    frame(1, "New words stand here.").write.parquet(str(source / "b"))
    run()
    got = ingest.latest(spark, str(tmp_path / "out" / "sentences"), "doc_id").collect()
    assert [r["sentence"] for r in got] == ["New word stand here ."]


def test_streaming_representatives_are_means_over_all_batches(spark, tmp_path):
    rows_ = [(i, i % 2, [float(i), float(i * i), 1.0]) for i in range(103)]
    folder = tmp_path / "embeddings.parquet"
    folder.mkdir()
    pq = pytest.importorskip("pyarrow.parquet")
    import pyarrow as pa

    for i, label, vector in rows_:  # more files than a micro-batch takes
        table = pa.table({"vec_id": pa.array([i]), "label": pa.array([label], pa.int32()), "embedding": pa.array([vector], pa.list_(pa.float32()))})
        pq.write_table(table, str(folder / f"part-{i:05d}.parquet"))
    got = rows(registry.streaming_ingest(spark, str(tmp_path)), "doc", "i")
    mean = lambda doc, k: sum(v[k] for _, d, v in rows_ if d == doc) / sum(d == doc for _, d, _ in rows_)
    assert [(d, i) for d, i, _ in got] == [(d, k) for d in (0, 1) for k in range(3)]
    assert all(abs(x - mean(d, i)) < 1e-5 for d, i, x in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    kw = keyword.keyword_table(spark, ["a"])
    posts = keyword.postings(text.sentences(docs), kw)
    for df in (text.sentences(docs), keyword.doc_scores(posts, kw), keyword.bm25_documents(docs, kw), topics.tfidf(docs, "doc_id"), topics.embed(docs, "doc_id")):
        assert df.count() == 0


def test_oracles_use_the_queries_constants(spark):
    assert oracles.QUESTION == registry.QUESTION
    assert rows(keyword.keyword_table(spark, registry.KEYWORDS), "ord") == oracles.KEYWORD_TERMS
    assert set(oracles.ORACLES) <= set(registry.QUERIES)


def test_keywords_reach_the_scan_side(spark):
    """The semi join on the question's terms stands below every aggregate."""
    docs = spark.createDataFrame([(0, "the ble of")], "doc_id long, text string")
    kw = keyword.keyword_table(spark, ["the"])
    plan = keyword.doc_scores(keyword.postings(text.sentences(docs), kw), kw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The cats sat here. The dog sat too."), (2, "A cat ran far away."), (3, None), (4, "")], "doc_id long, text string")
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path / "none"))
    tables = index.build(docs, str(tmp_path / "index"))
    kw = keyword.keyword_table(spark, ["cats", "sat"])
    known = keyword.known_terms(kw)
    posts = index.postings(tables, [t for t, _, _ in known])
    assert rows(posts, "doc_id", "term") == [(1, "cat", [0]), (1, "sat", [0, 1]), (2, "cat", [0])]
    assert "PushedFilters: [In(term" in posts._jdf.queryExecution().explainString(posts._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    plain = keyword.postings(text.sentences(docs), kw)
    assert rows(keyword.scores_of_postings(posts, kw), "doc_id") == rows(keyword.doc_scores(plain, kw), "doc_id")
    in_row = keyword.sentence_hits(tables["sentences"], known).select("doc_id", "sent_id", "hits")
    assert rows(in_row, "doc_id", "sent_id") == rows(keyword.sentence_counts(plain, kw), "doc_id", "sent_id")
    with pytest.raises(ValueError):
        keyword.keyword_table(spark, ["w"] * (keyword.MOST_TERMS + 1))


def test_questions_read_the_index_once(spark):
    """A question's plan has one scan of a stored table for its texts, and none of the documents."""
    for name in ("keyword_global_count", "keyword_concat", "pack_context", "keyword_context"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and plan.count("sentences]") <= 1 and plan.count("/sentences") <= 1


def test_tables_are_rebuilt_when_the_source_changes(spark, tmp_path):
    frame = lambda t: spark.createDataFrame([(1, t)], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    frame("The first text is here.")
    assert registry.stored(spark, str(tmp_path))["sentences"].first()["sentence"] == "The first text is here ."
    frame("Another text is here, and it is longer.")
    assert registry.stored(spark, str(tmp_path))["sentences"].first()["sentence"].startswith("Another text")


def test_topic_tables(spark, tmp_path):
    docs = spark.createDataFrame([(0, "red apple red"), (1, "blue sky")], "doc_id long, text string")
    members = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, topic string")
    tables = topics.build(docs, members, "doc_id", str(tmp_path / "topics"))
    assert rows(tables["members"], "doc_id") == [(0, "a"), (1, "b")] and tables["vocabulary"].count() == 4
    sims = topics.match(spark.createDataFrame([(0, "an apple")], "query_id int, text string"), tables["vocabulary"], tables["centroids"])
    assert [r["topic"] for r in sims.collect()] == ["a"]
    with pytest.raises(FileNotFoundError):
        topics.load(spark, str(tmp_path / "none"))


def test_plugins_as_parameters(spark):
    docs = spark.createDataFrame([(1, "ab cd. ef gh ij."), (2, None)], "doc_id long, text string")
    upper = text_plugin(lambda xs: [x.upper() for x in xs])
    long = splitter_plugin(lambda xs: [len(x) > 8 for x in xs])
    got = rows(text.sentences(docs, lemmatizer=upper, splitter=long), "doc_id", "sent_id")
    assert got == [(1, 0, "AB CD. EF GH IJ.")]
    vector = topics.embed(docs, "doc_id", embedder=embedder_plugin(lambda: lambda xs: [[len(x), 1] for x in xs]))
    assert rows(vector, "doc_id") == [(1, [16.0, 1.0]), (2, [0.0, 1.0])]


def test_large_documents_are_clustered_as_small_ones(spark, monkeypatch):
    """Where a document exceeds what a task takes, its clusters come from jobs, and the elbow is the same."""
    import numpy as np

    r = np.random.default_rng(5)
    spots = r.normal(size=(4, 6)) * 20
    data = [(d, (spots[i % (3 + d)] + r.normal(size=6)).tolist()) for d in (0, 1) for i in range(90)] + [(2, [1.0] * 6)] * 3 + [(None, [1.0] * 6), (3, None)]
    df = spark.createDataFrame(data, "doc long, vector array<double>").repartition(3)
    small = {x["doc"]: (x["k"], x["rep"]) for x in vectors.rep_pca_kmeans(df).collect()}
    monkeypatch.setattr(vectors, "GROUP_ROWS", 50)
    large = {x["doc"]: (x["k"], x["rep"]) for x in vectors.rep_pca_kmeans(df).collect()}
    assert set(small) == set(large) == {0, 1, 2}
    for d in (0, 1, 2):
        assert small[d][0] == large[d][0] and small[d][1] == pytest.approx(large[d][1])


def test_pca_dims_equal_a_full_decomposition(spark):
    import numpy as np

    r = np.random.default_rng(6)
    data = {d: r.normal(size=(40, 5)) * np.array([10, 5, 1, 0.1, 0.01]) ** d for d in (1, 2)}
    df = spark.createDataFrame([(d, x.tolist()) for d, xs in data.items() for x in xs], "doc long, vector array<double>").repartition(7)
    for row in vectors.rep_adaptive_pca(df).collect():
        xs = data[row["doc"]]
        values = np.linalg.svd(xs - xs.mean(axis=0), compute_uv=False) ** 2
        assert row["dim"] == int(np.searchsorted(np.cumsum(values) / values.sum(), vectors.VARIANCE) + 1)
        assert row["rep"] == pytest.approx(xs.mean(axis=0).tolist())


def test_topic_clusters_part_unlike_documents(spark):
    docs = spark.createDataFrame([(i, ("red apple tree fruit " if i % 2 else "blue sky cloud rain ") * 5) for i in range(20)], "doc_id long, text string")
    got = {r["doc_id"]: r["topic"] for r in clusters.topic_model(docs, "doc_id", 2)[0].collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == len({got[i] for i in range(1, 20, 2)}) == 1 and got[0] != got[1]


def test_several_questions_in_two_stages(spark, monkeypatch):
    df = spark.createDataFrame([(d, 10 * d + i, [float(d == 0), float(d == 1), 0.1 * i]) for d in range(3) for i in range(4)], "doc long, id long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, [0.0, 1.0, 0.0])], "query_id long, q array<double>")
    want = [(7, 0, 0, 1), (7, 0, 1, 2), (8, 1, 10, 1), (8, 1, 11, 2)]
    for block in (1000, 1):
        monkeypatch.setattr(vectors, "QUESTIONS", block)
        got = vectors.two_stage(df, vectors.rep_mean(df), q, 1, 2).select("query_id", "doc", "id", "rank")
        assert rows(got, "query_id", "rank") == want


def test_pages_in_order(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "c"), (1, 0, 1, "b"), (1, 0, 0, "a"), (2, 0, 0, "z")], "doc_id long, page int, line_no int, line string")
    assert rows(text.assemble(blocks), "doc_id") == [(1, "a\nb\nc"), (2, "z")]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quillsift.sources import shared

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_dir(Fake)


HOSTILE = {
    "host": "http://" + "a." * 500_000,
    "labels": "http://" + "a.b1." * 200_000 + "com",
    "token": "a" * 1_000_000 + "=",
    "base64": "aGVsbG8" * 100_000 + "é",
    "open": "<" * 1_000_000,
    "blocks": "<p " * 300_000 + "<x<p>",
    "scripts": "<script " * 100_000 + "<!--" * 100_000 + "--> end <style>",
    "spaces": "a" + " " * 1_000_000 + "b",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_patterns_are_linear(spark, name):
    """A million characters that make a pattern look far ahead in vain: no crash, and seconds."""
    for expression in (text.clean_text, text.token_array, text.html_lines, text.strip):
        for given in ("warm", HOSTILE[name]):
            began = time.perf_counter()
            spark.createDataFrame([(given,)], "x string").select(F.length(F.to_json(F.array(expression(F.col("x")))))).collect()
        assert time.perf_counter() - began < 5


def test_rewritten_patterns_agree(spark):
    """The forms for Java against the fixed values, on random strings."""
    r = random.Random(5)
    hosts = ["http" + r.choice(["s", ""]) + "://" + "".join(r.choice("ab1-..Z/ ") for _ in range(r.randrange(9))) for _ in range(3000)]
    tokens = ["".join(r.choice("ab1-=é ") for _ in range(r.randrange(8))) for _ in range(3000)]
    pages = ["".join(r.choice(["<", ">", "<p", "</p>", "<script", "</SCRIPT>", "<!--", "-->", "x", " ", "<Style>", "</style>", "\n", "&lt;"]) for _ in range(r.randrange(14))) for _ in range(3000)]
    got = spark.createDataFrame([(h,) for h in hosts], "x string").select(F.col("x").rlike(text.URL_START)).collect()
    assert [g[0] for g in got] == [bool(re.search(text.URL_LINE, h)) for h in hosts]
    got = spark.createDataFrame([(t,) for t in tokens], "x string").select(text.token_array(F.col("x"))).collect()
    assert [g[0] for g in got] == [[w for w in t.split() if re.search(text.TOKEN, w)] for t in tokens]

    def blocks(page):
        for pattern, by in ((text.DROPPED_MARKUP, ""), (text.BLOCK_TAG, "\n"), ("<[^>]*>", "")):
            page = re.sub(pattern, by, page)
        for entity, char in text.ENTITIES:
            page = page.replace(entity, char)
        return [x.strip() for x in page.split("\n") if x.strip()]

    got = spark.createDataFrame([(p,) for p in pages], "x string").select(text.html_lines(F.col("x"))).collect()
    assert [g[0] for g in got] == [blocks(p) for p in pages]
