"""What a review of larger tables found: each test fails on the code before its finding's change."""

import math
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillsift.operators import associations, clusters, impacts, keyword, segment, tagger, topics, vectors
from quillsift.plans import registry
from quillsift.sources import files
from quillsift.streaming import live


def test_zeros_keep_their_sign(spark):
    given = spark.createDataFrame([([-1e-9, -0.0, 0.0, 1e-9, -0.5, None, -4e-7],)], "v array<double>")
    got = given.select(registry.rounded("v").alias("v")).first()["v"]
    assert [None if x is None else (x, math.copysign(1, x)) for x in got] == [(0, -1), (0, -1), (0, 1), (0, 1), (-0.5, -1), None, (0, -1)]


def test_page_files_takes_more_pages_than_an_export(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_FILES", 3)
    pages = [(i, f"u{i}", None if i == 2 else f"<p>one {i}</p>\r\n<p>\ttwo x</p>") for i in range(5)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, blocks = (sorted(tuple(r) for r in f(spark, str(tmp_path)).collect()) for f in (registry.page_files, registry.page_blocks))
    assert len(got) == 8 and got == blocks


def seconds(df):
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


def test_lengths_are_computed_once(spark):
    """Not once for each component: 12,000 components took 144 million steps."""
    long = spark.range(1).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(12_000)), lambda i: F.concat(F.lit("w"), i))).alias("text"))
    assert seconds(clusters.unit_vectors(long, "id", features=1 << 20)) < 15
    assert seconds(spark.range(1).select(vectors.normalized(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i.cast("double"))).alias("v"))) < 10
    short = spark.range(20_000).select("id", F.concat(F.lit("one two three "), F.col("id")).alias("text"))
    assert seconds(topics.embed(short, "id", dims=256)) < 15


def test_a_share_does_not_grow_with_the_file(spark, tmp_path, monkeypatch):
    rows = spark.range(1000)
    rows.write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(files, "PART_BYTES", 100)
    dealt = files.spread(spark.read.parquet(f"{tmp_path}/t"), f"{tmp_path}/t", "id")
    assert dealt.rdd.getNumPartitions() > 40
    assert "Exchange" not in dealt.groupBy("id", F.col("id") % 7).count()._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "").split("Exchange hashpartitioning(id", 1)[0]


def test_postings_are_dealt_once(spark, tmp_path, monkeypatch):
    from quillsift.sources import index

    monkeypatch.setattr(index, "POSTING_BYTES", 500)
    docs = spark.createDataFrame([(i, f"one two three w{i}. two w{i} four five. one one six.") for i in range(200)], "doc_id long, text string")
    made = index.build(docs, f"{tmp_path}/index")
    assert len([f for f in (tmp_path / "index" / "postings").iterdir() if f.name.endswith(".parquet")]) > 6  # as many as the sentences ask for, not a fixed number
    got = {(r["term"], r["doc_id"]): r["sent_ids"] for r in made["postings"].collect()}
    assert got["two", 7] == [0, 1] and got["one", 7] == [0, 2] and len(got) == 200 * 7


def test_a_question_builds_its_own_representatives(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(registry.vectors, "rep_pca_kmeans", lambda rows: asked.append("kmeans"))
    monkeypatch.setattr(registry, "kept", lambda spark, source, tag, build: build())
    assert len(registry.two_stage_question(spark, "/root/testdata/sf0.001").collect()) == 3 and not asked


def test_documents_are_clustered_together():
    """many documents in one array, as each by itself."""
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (2, 1), (5, 3), (40, 9)):
        x = rng.normal(size=(20, n, 4)).round(1)
        x[0] = 0.0
        labels, centres, errors = vectors.kmeans_of_each(x, k)
        for i in range(len(x)):
            one = vectors.kmeans(x[i], k)
            assert (labels[i] == one[0]).all() and np.allclose(centres[i], one[1]) and np.isclose(errors[i], one[2])


def test_small_documents_need_no_moments_and_no_postings(spark, monkeypatch):
    """a document's moments are as many bytes as 64 vectors; a two-stage question reads no postings."""

    def never(*args):
        raise AssertionError

    monkeypatch.setattr(vectors, "_moments", never)
    monkeypatch.setattr(registry.index, "write_postings", never)
    monkeypatch.setattr(registry, "kept", lambda spark, source, tag, build: build())
    given = spark.createDataFrame([(d, [float(d or 0), float(i), 1.0]) for d in (None, 1, 2) for i in range(3)] + [(3, None), (4, [1.0, 2.0])], "doc long, vector array<double>")
    assert sorted(((r["doc"] or 0, r["dim"], r["rep"]) for r in vectors.rep_adaptive_pca(given).collect())) == [(0, 1, [0, 1, 1]), (1, 1, [1, 1, 1]), (2, 1, [2, 1, 1]), (4, 1, [1, 2])]
    assert len(registry.two_stage_adaptive_context(spark, "/root/testdata/sf0.001").collect()) > 0


def test_terms_are_hashed_once_for_a_batch(spark):
    """60 places were searched in each text, and each token hashed anew."""
    given = spark.range(2000).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("w"), i)), " ").alias("text"))
    assert "conv(" not in topics.embed(given, "id")._jdf.queryExecution().toString() and seconds(topics.embed(given, "id")) < 20
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one one two")], "id int, text string")
    lengths = {r["id"]: sorted(x for x in r["vector"] if x) for r in topics.embed(odd, "id").collect()}
    assert lengths[1] == lengths[2] == [] and [round(x, 6) for x in lengths[3]] == [0.447214, 0.894427]


def test_classes_by_batch(spark):
    """The classes of a batch's words, each looked at once, as those of the column expression."""
    given = spark.createDataFrame([(1, "The cat  runs quickly . 12 ieren Über ²x é - o'x"), (2, ""), (3, None), (4, "nation")], "id int, sentence string")
    got = {r["id"]: r["symbols"] for r in tagger.classed(given, "id").collect()}
    assert got == {r["id"]: r["s"] or [] for r in given.select("id", tagger.classes(F.col("sentence")).alias("s")).collect()}


def test_gathering_is_linear():
    """F8: a run of pieces that become valid late; each step went over all tags before it."""
    n = 200_000
    start = time.time()
    got = tagger._gathered(["x."] * n + ["y."], [(False, False, False)] * (n - 1) + [(False, True, False), (False, False, True)])
    assert len(got) == 1 and time.time() - start < 5
    assert tagger._gathered(["a.", "b.", "c"], [(True, True, True), (False, False, True), (False, True, False)]) == ["a. b. c"]


def test_postings_are_gathered_where_they_are(spark):
    """no sort of every posting and no shuffle; documents that go over many batches, ids that come twice, null ids."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(d, s, ["a", f"w{s % 2}"] if s % 3 else []) for d in (None, None, 1, 2, 2, 3) for s in range(4)] + [(4, 0, None)]
        given = spark.createDataFrame(rows, "doc_id long, sent_id int, terms array<string>").coalesce(1).sortWithinPartitions("doc_id")
        index = keyword.document_postings(given)
        got = {(r["doc_id"], r["term"]): r["postings"] for r in index.collect()}
        assert got == {(d, t): p for d in (None, 1, 2, 3) for t, p in (("a", [1, 2]), ("w0", [2]), ("w1", [1]))}
        assert len(index.collect()) == 12
        twice = index.select("doc_id", "term", F.explode(F.array("postings", F.array(F.lit(9)), "postings")).alias("postings"))
        assert {(r["doc_id"], r["term"]): r["postings"] for r in keyword.merged_postings(twice).collect()} == {k: [*p, 9] for k, p in got.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for query in (registry.inverted_index, registry.merge_postings, registry.term_sentence_freq):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Exchange") == 1, plan


def test_weights_are_dealt_by_their_number(spark, monkeypatch):
    """a fixed number of tasks sorted all weights and held a document's as one list."""
    monkeypatch.setattr(topics, "COUNT_BYTES", 100)
    units = spark.createDataFrame([(i if i else None, f"one two w{i} w{i % 7}") for i in range(300)], "doc_id long, text string")
    for bound in (topics.BROADCAST_ROWS, 3):
        monkeypatch.setattr(topics, "BROADCAST_ROWS", bound)
        found = topics.tfidf(units, "doc_id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and max(int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)) > 20
        lengths = found.groupBy("doc_id").agg(F.round(F.sum(F.col("w") * F.col("w")), 9).alias("s")).collect()
        assert len(lengths) == 300 and all(r["s"] == 1 for r in lengths)


def test_impacts_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """a fixed number of tasks sorted all impacts, and the sentences' postings were built for it too."""
    monkeypatch.setattr(impacts, "COUNT_BYTES", 500)
    units = spark.createDataFrame([(i, ["one", "two", f"w{i}"]) for i in range(300)], "doc_id long, terms array<string>")
    impacts.build(units, ["doc_id"], f"{tmp_path}/impacts")
    assert len([f for f in (tmp_path / "impacts" / "postings").iterdir() if f.name.endswith(".parquet")]) > 6


def test_associates_need_no_stored_matrix(spark, tmp_path, monkeypatch):
    """the whole matrix was shuffled by strings, written and read twice."""
    sents = spark.createDataFrame([(" ".join(f"t{(i * j * j + j) % (3 + i % 40)}" for j in range(i % 17)),) for i in range(400)] + [(None,), ("",), ("t1 t1 t1",)], "sentence string")
    asked = ["t0", "t3", "t17", "unknown"]
    of = lambda df: [tuple(r) for r in df.orderBy("term", "rank").collect()]
    expected = of(associations.associates(associations.build(sents, f"{tmp_path}/a"), asked))
    assert len(expected) == 12
    monkeypatch.setattr(associations, "TOKENS", 300)
    for most in (100_000, 7, 1):  # terms that are known by number: all, some, one
        assert of(associations.associates_of(sents, asked, most=most)) == expected
    assert not of(associations.associates_of(sents.limit(0), asked)) and not of(associations.associates_of(sents, ["unknown"]))
    monkeypatch.setattr(associations, "build", None)
    assert registry.associated_keywords(spark, "/root/testdata/sf0.001").count() > 0


def test_associated_scores_need_no_postings(spark, monkeypatch):
    """a single question had the postings of all terms built and stored."""
    sents = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["b"]), (2, 0, []), (3, 0, ["c"]), (4, 0, None)], "doc_id long, sent_id int, terms array<string>")
    assert sorted(tuple(r) for r in keyword.postings_of_terms(sents, ["b", "c", "x"]).collect()) == [(1, "b", 0), (1, "b", 1), (3, "c", 0)]
    assert keyword.postings_of_terms(sents, []).count() == 0
    monkeypatch.setattr(registry.index, "write_postings", None)
    monkeypatch.setattr(registry, "kept", lambda spark, source, tag, build: build())
    assert registry.associated_doc_score(spark, "/root/testdata/sf0.001").count() == 200


def test_a_share_is_counted_in_texts(spark, tmp_path, monkeypatch):
    """a file that holds equal texts once is small, whatever its texts come to; a task took all of them."""
    spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("one two "), 500).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(files, "TEXT_BYTES", 100_000)
    assert files.size(spark, f"{tmp_path}/documents.parquet") < 100_000
    for query in (registry.lemma_tokens, registry.extract_keywords, registry.documents):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() == 40


def test_runs_are_segmented_together(spark, monkeypatch):
    """each character was walked in Python, words were sent one by one, the trie was made for each task."""
    words = [("ab", 5), ("abc", 2), ("bc", 9), ("cab", 3), ("ca", 1), ("é1", 4), ("好的", 2), ("aa", 2), ("aaaa", 4)]
    rng = np.random.default_rng(1)
    texts = [None, "", "...", "ABC", "x" * 50, "aaaaaaaaa", "İab"] + ["".join(rng.choice(list("abcé1好的.x "), size=n)) for n in (1, 2, 5, 40, 300)] * 3
    monkeypatch.setattr(segment, "TOGETHER", 60)
    monkeypatch.setattr(segment, "LONG", 100)
    one = segment.Segmenter(words)
    got = [Counter() for _ in texts]
    for of, terms, counts in segment.Together(one).counted(texts):
        for i, w, n in zip(of.tolist(), terms, counts.tolist()):
            got[i][w] += n
    assert got == [Counter([] if t is None else one.words_of(t)) for t in texts]
    assert sorted(segment.Together(segment.Segmenter([])).counted(["ab"])[0][1]) == ["a", "b"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, "cab")], "doc_id long, text string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(keyword.top_terms(segment.term_counts(docs, words))) == rows(keyword.extract_keywords(docs, segment=segment.segmenter(words)))


def test_compaction_deals_sentences_once(spark, tmp_path):
    """sentences and their terms were dealt by the join with the last runs and again by range; texts were dealt twice for a run."""
    schema, at = "doc_id long, text string", f"{tmp_path}/live"
    for rows in (
        [(1, "one two three."), (2, "   "), (2, "\ta b c d"), (3, " x y z."), (3, "  "), (4, "four five six."), (None, "a b c.")],
        [(1, None), (4, "six seven eight. nine ten eleven."), (5, "")],
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/given")
        live.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/given"), at, f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{at}/run=0/sentences").columns == ["doc_id", "sent_id", "sentence"]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{at}/run=0/changes").collect()) == [(1, False), (2, True), (3, False), (4, False)]
    expected = [(3, 0, "x y z ."), (4, 0, "six seven eight ."), (4, 1, "nine ten eleven .")]
    now = lambda: sorted((r["doc_id"], r["sent_id"], r["sentence"]) for r in live.current(spark, at)["sentences"].collect())
    assert now() == expected
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = live._merged(spark, at, -1, [0, 1], 3)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        live.compact(spark, at)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert now() == expected and live.postings(spark, at, ["seven"]).count() == 1
