"""Inverted index and keyword ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..sources.shared import materialize
from .text import lemma, sentences, token_array
from .words import counter, weigher

# Weights of a document's score, and those times 20 as whole numbers.
COVERAGE, HITS = 0.8, 0.05
K1, B = 1.2, 0.75


#: Terms of a question; its tables are broadcast.
MOST_TERMS = 10_000
#: Terms up to which a condition is written out, one comparison each.
WRITTEN = 64


def keyword_table(spark: SparkSession, words, raw: bool = False) -> DataFrame:
    """(term, ord, times): distinct terms, by default as lemmas like the index, with how often the list has them.

    The list is a question's, of at most MOST_TERMS words (more raise), so what
    is broadcast has that bound.
    """
    words = list(words)
    if len(words) > MOST_TERMS:
        raise ValueError(f"a question has at most {MOST_TERMS} keywords")
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, ord int")
    term = F.lower(F.col("term")) if raw else lemma(F.lower(F.col("term")))
    found = rows.groupBy(term.alias("term")).agg(F.min("ord").alias("ord"), F.count("*").alias("times")).collect()
    return spark.createDataFrame(found, "term string, ord int, times long")


def known_terms(keywords: DataFrame) -> list[tuple[str, int, int]]:
    """The rows (term, ord, times) of a question's keyword table, in order; they are what the question lists."""
    return [(r["term"], r["ord"], r["times"]) for r in keywords.orderBy("ord").collect()]


def matched(terms: Column, known: list[tuple[str, int, int]]) -> Column:
    """Sum of the times of the known terms that an array of distinct terms has, within the row."""
    if len(known) > WRITTEN:
        return weigher({t: n for t, _, n in known})(terms)
    return sum((F.when(F.array_contains(terms, t), n).otherwise(0) for t, _, n in known), F.lit(0)).cast("long")


def with_terms(sents: DataFrame) -> DataFrame:
    """Sentences with their distinct index tokens, like those of a stored index."""
    return sents.withColumn("terms", F.array_distinct(token_array(F.col("sentence"))))


def sentence_hits(sents: DataFrame, known: list[tuple[str, int, int]]) -> DataFrame:
    """sents(doc_id, sent_id, sentence, terms) with ``hits``, those with any; a projection of the scan."""
    return sents.withColumn("hits", matched(F.col("terms"), known)).where("hits > 0")


def scores_of_postings(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """``doc_scores`` of stored postings(doc_id, term, sent_ids)."""
    rows = posts.select("doc_id", "term", F.size("sent_ids").cast("long").alias("sentences")).join(F.broadcast(keywords), "term")
    return _scored(rows)


def sentence_tokens(sents: DataFrame) -> DataFrame:
    return sents.select("doc_id", "sent_id", F.explode(F.array_distinct(token_array(F.col("sentence")))).alias("term"))


def postings(sents: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, sent_id), distinct.

    Each sentence's tokens are made distinct in place, so there is no shuffle.
    Keywords (a list from a question) cut the tokens before anything else, as
    a broadcast semi join.
    """
    rows = sentence_tokens(sents)
    if keywords is not None:
        rows = rows.join(F.broadcast(keywords.select("term")), "term", "left_semi")
    return rows.select("doc_id", "term", "sent_id")


def postings_of_terms(sents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, term, sent_id) of a question's terms in sents(doc_id, sent_id, terms), distinct terms; a projection of the scan, for one question whose index has no postings."""
    return sents.select("doc_id", F.explode(F.array_intersect("terms", F.array(*[F.lit(t) for t in terms]).cast("array<string>"))).alias("term"), "sent_id")


def inverted_index(posts: DataFrame) -> DataFrame:
    """posts, distinct -> (doc_id, term, postings): ascending sentence ids of one document's term."""
    return posts.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("sent_id")).alias("postings"))


def merge_postings(indexes: DataFrame) -> DataFrame:
    """The union of several indexes' postings for each (doc_id, term)."""
    return indexes.groupBy("doc_id", "term").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("postings")))).alias("postings"))


def document_postings(rows: DataFrame) -> DataFrame:
    """rows(doc_id, sent_id, terms), where those of a document stand together -> its inverted index (doc_id, term, postings).

    A document is gathered where its rows are, in Arrow batches, so nothing is
    shuffled and no task holds more than a batch and a document.
    """

    def flat(batch):
        lists = batch.column("terms")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        return sizes, coded.dictionary, coded.indices.to_numpy(), np.repeat(batch.column("sent_id").to_numpy(zero_copy_only=False), sizes)

    return _gathered(rows.select("doc_id", "sent_id", "terms"), flat)


def merged_postings(indexes: DataFrame) -> DataFrame:
    """``merge_postings`` of indexes(doc_id, term, postings) where the rows of a document stand together."""

    def flat(batch):
        lists = batch.column("postings")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = batch.column("term").dictionary_encode()
        return sizes, coded.dictionary, np.repeat(coded.indices.to_numpy(), sizes), lists.flatten().to_numpy(zero_copy_only=False)

    return _gathered(indexes.select("doc_id", "term", "postings"), flat)


def _gathered(rows: DataFrame, flat) -> DataFrame:
    """(doc_id, term, postings) of rows of adjacent documents; ``flat`` gives a batch's (pairs in each row, terms, a term's number and a sentence for each pair)."""
    given = rows.schema["doc_id"]

    def run(batches):
        import pyarrow as pa

        def made(held):
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            docs = batch.column("doc_id").dictionary_encode(null_encoding="encode")
            sizes, terms, numbers, sents = flat(batch)
            key = np.repeat(docs.indices.to_numpy().astype(np.int64), sizes) * max(1, len(terms)) + numbers
            order = np.lexsort((sents, key))
            key, sents = key[order], sents[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            kept = first | np.concatenate([[True], sents[1:] != sents[:-1]])[: len(key)]  # distinct
            key, sents, first = key[kept], sents[kept], first[kept]
            starts = np.flatnonzero(first)
            postings = pa.ListArray.from_arrays(pa.array([*starts, len(key)], pa.int32()), pa.array(sents, pa.int32()))
            doc, term = np.divmod(key[starts], max(1, len(terms)))
            return pa.RecordBatch.from_arrays([docs.dictionary.take(pa.array(doc)), terms.take(pa.array(term)), postings], names=["doc_id", "term", "postings"])

        held: list = []  # batches whose last document may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_pylist()
            cut = batch.num_rows
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            if cut or (held and held[-1].column("doc_id")[-1].as_py() != ids[0]):
                whole = [*held, batch.slice(0, cut)] if cut else held
                yield made(whole)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield made(held)

    return rows.mapInArrow(run, StructType([StructField("doc_id", given.dataType), StructField("term", StringType()), StructField("postings", ArrayType(IntegerType()))]))


def term_sentence_freq(posts: DataFrame) -> DataFrame:
    return posts.groupBy("doc_id", "term").agg(F.count("*").alias("sentences"))


def _scored(lengths: DataFrame) -> DataFrame:
    out = lengths.groupBy("doc_id").agg(F.count("*").alias("coverage"), F.sum(F.col("sentences") * F.col("times")).alias("total"))
    return out.withColumn("points", 16 * F.col("coverage") + F.col("total")).withColumn("score", F.col("points") / 20.0)


def doc_scores(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, coverage, total, points, score) of documents with a hit; score is 0.8 coverage + 0.05 total, points is 20 times that."""
    return _scored(term_sentence_freq(posts).join(F.broadcast(keywords), "term"))


def with_all_documents(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents without a hit get zeros."""
    return docs.select("doc_id").join(scores, "doc_id", "left").fillna(0, ["coverage", "total", "points", "score"])


def top_documents(scores: DataFrame, n: int) -> DataFrame:
    """The n best with rank; ties to the smaller id.  The window sees n rows."""
    best = scores.orderBy(F.col("points").desc(), "doc_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("points").desc(), "doc_id")))


def sentence_counts(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, sent_id, hits): entries of the keyword list that are in the sentence."""
    return posts.join(F.broadcast(keywords), "term").groupBy("doc_id", "sent_id").agg(F.sum("times").alias("hits"))


def intersection(posts: DataFrame) -> DataFrame:
    """(doc_id, sent_id) of sentences with every keyword that their document has."""
    per_sentence = posts.groupBy("doc_id", "sent_id").agg(F.count("*").alias("n"))
    per_doc = posts.groupBy("doc_id").agg(F.count_distinct("term").alias("terms"))
    return per_sentence.join(per_doc, "doc_id").where("n = terms").select("doc_id", "sent_id")


def missing_keywords(keywords: DataFrame, posts: DataFrame) -> DataFrame:
    return keywords.join(posts.select("term").distinct(), "term", "left_anti").select("term")


def extract_keywords(docs: DataFrame, top_n: int = 8, segment=token_array) -> DataFrame:
    """(doc_id, keywords): a document's most frequent tokens, ties in text order, joined by spaces.

    ``segment`` gives a text's tokens; for unspaced text see ``operators.segment``.
    """
    counts = docs.select("doc_id", F.explode(segment(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return top_terms(counts, top_n)


def top_terms(counts: DataFrame, top_n: int = 8) -> DataFrame:
    """counts(doc_id, term, n) -> (doc_id, keywords), as ``extract_keywords``."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "term"))
    best = counts.withColumn("r", rank).where(F.col("r") <= top_n)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ")
    return best.groupBy("doc_id").agg(joined.alias("keywords"))


def parse_reply(reply: Column) -> tuple[Column, Column]:
    """The two bracketed lists of a reply; both empty unless there are exactly two."""
    groups = F.regexp_extract_all(reply, F.lit(r"\[(.*?)\]"), F.lit(1))
    part = lambda i: F.when(F.size(groups) == 2, F.split(groups[i], ", ")).otherwise(F.array().cast("array<string>"))
    return part(0), part(1)


def regex_count(text: Column, words) -> Column:
    """Non-overlapping whole-word matches, case-sensitive; no words, no matches.

    Long lists go through an automaton in place of an expression, with equal counts.
    """
    if not words:
        return F.lit(0)
    if len(words) > WRITTEN:
        return counter(list(words))(text)
    return F.regexp_count(text, F.lit(r"(?U)\b(" + "|".join(rf"\Q{w}\E" for w in words) + r")\b"))


def _bm25(tokens: DataFrame, keys: list[str], keywords: DataFrame) -> DataFrame:
    """Okapi BM25 over units ``keys``; tokens(keys, terms array)."""
    known = [t for t, _, _ in known_terms(keywords)]
    found = tokens.select(*keys, F.size("terms").alias("dl"), F.filter("terms", lambda t: t.isin(*known)).alias("found"))
    each = F.transform(F.array_distinct("found"), lambda t: F.struct(t.alias("term"), F.size(F.filter("found", lambda x: x == t)).cast("long").alias("tf")))
    units = materialize(found.select(*keys, "dl", each.alias("hits")), "bm25")  # a few numbers for each unit, from one pass over the texts
    stats = units.agg(F.count("*").alias("units"), F.avg("dl").alias("avgdl"))  # one row
    hits = units.where(F.size("hits") > 0).select(*keys, "dl", F.explode("hits").alias("x")).select(*keys, "dl", "x.term", "x.tf")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each keyword
    idf = F.log(1 + (F.col("units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy(*keys).agg(F.round(F.sum(weight), 4).alias("score"))


def bm25_documents(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    return _bm25(docs.select("doc_id", token_array(F.col("text")).alias("terms")), ["doc_id"], keywords)


def bm25_sentences(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    return _bm25(sentences(docs).select("doc_id", "sent_id", token_array(F.col("sentence")).alias("terms")), ["doc_id", "sent_id"], keywords)
