"""TF-IDF, topic centroids and topic questions, as relations of (unit, term, weight)."""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..sources.shared import BROADCAST_ROWS, exists, materialize, size

# Common English function words, left out of topics.
STOP_WORDS = tuple("a an and are as at be by for from has have he her his i in is it its of on or she that the their them they this to was we were which will with you your".split())
TERM = r"[\p{L}\p{N}_]{2,}"


def unit_terms(units: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, term, tf) without stop words."""
    terms = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TERM), F.lit(0))
    rows = units.select(key, F.explode(terms).alias("term")).where(~F.col("term").isin(*STOP_WORDS))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(units: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, idf): ln((1 + n) / (1 + df)) + 1."""
    n = units.agg(F.count("*").alias("units"))  # one row
    return counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", (F.log((1 + F.col("units")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(counts: DataFrame, vocab: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(key, term, w) of unit length for each key; the terms of one key meet once, dealt over ``tasks``."""
    raw = counts.join(vocab, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    dealt = raw.repartition(tasks, key) if tasks else raw
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # a window holds one key's terms
    return dealt.select(key, "term", (F.col("w") / length).alias("w"))


#: Bytes of written counts that a task takes.
COUNT_BYTES = 8 << 20


def weights(units: DataFrame, key: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vocabulary, weights); term counts and vocabulary are written, so the texts are read once.

    A vocabulary that is counted to be small is broadcast; beyond that terms
    and counts meet by a shuffle.  Tasks are as many as the counts ask for, so
    that none sorts more than a share, however many there are.
    """
    spark = units.sparkSession
    counts = materialize(unit_terms(units, key, text_col), "term-counts")
    vocab = materialize(vocabulary(units, counts), "vocabulary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size(spark, counts.materialized_at) // COUNT_BYTES))
    few = vocab.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return vocab, weighted(counts if few else counts.repartition(tasks, "term"), F.broadcast(vocab) if few else vocab, key, tasks)


def tfidf(units: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    return weights(units, key, text_col)[1]


def build(units: DataFrame, assigned: DataFrame, key: str, path: str, text_col: str = "text") -> dict[str, DataFrame]:
    """Topic tables under ``path``: vocabulary(term, idf), members(key, topic) and centroids(topic, term, w)."""
    spark = units.sparkSession
    vocab, ws = weights(units, key, text_col)
    assigned.select(key, "topic").write.mode("overwrite").parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    centroids(ws, members, key).write.mode("overwrite").parquet(f"{path}/centroids")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The topic tables; raises FileNotFoundError where one was not written to its end."""
    names = ("vocabulary", "members", "centroids")
    for name in names:
        if not exists(spark, f"{path}/{name}/_SUCCESS"):
            raise FileNotFoundError(f"no table {name} under {path}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def centroids(weights: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """assigned(key, topic) -> (topic, term, w): mean vectors, sparse."""
    sizes = assigned.groupBy("topic").agg(F.count("*").alias("n"))
    sums = weights.join(assigned.select(key, "topic"), key).groupBy("topic", "term").agg(F.sum("w").alias("w"))
    return sums.join(sizes, "topic").select("topic", "term", (F.col("w") / F.col("n")).alias("w"))


def match(question: DataFrame, vocab: DataFrame, cents: DataFrame) -> DataFrame:
    """question(query_id, text) -> (topic, sim) of every topic with a term in common; the question's terms are broadcast, being few."""
    q = weighted(unit_terms(question, "query_id"), vocab, "query_id").select("term", F.col("w").alias("qw"))
    lengths = cents.groupBy("topic").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = cents.join(F.broadcast(q), "term").groupBy("topic").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dots.join(lengths, "topic").select("topic", F.round(F.col("dot") / F.col("length"), 6).alias("sim"))


def embed(units: DataFrame, *keys: str, text_col: str = "text", dims: int = 64, embedder=None) -> DataFrame:
    """(keys, vector) within the row, in Arrow batches: by default a hashed bag of words of unit length, a deterministic stand-in for a neural embedder.

    ``embedder`` may be a plug-in (see ``functions.plugins``), a function of the
    text column.  A text without terms has a zero vector.
    """
    if embedder is not None:
        return units.select(*keys, embedder(F.col(text_col)).alias("vector"))
    given = units.select(*keys, F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TERM), F.lit(0)).alias("terms"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists, n = batch.column("terms"), batch.num_rows
            rows = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            coded = lists.flatten().dictionary_encode()  # a batch's terms are hashed once each
            places = np.array([int(md5(t).hexdigest()[:6], 16) % dims for t in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
            counts = np.bincount(rows * dims + places[coded.indices.to_numpy()], minlength=n * dims).reshape(n, dims).astype(np.float64)
            length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array((counts / np.where(length > 0, length, 1)).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], vectors], names=[*keys, "vector"])

    return given.mapInArrow(run, StructType([*given.drop("terms").schema.fields, StructField("vector", ArrayType(DoubleType()))]))
