"""The stored index of a corpus: sentences and postings, written once and read by every question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import sentences, token_array
from .shared import exists, size

TABLES = ("documents", "sentences", "postings")


def build(docs: DataFrame, path: str, tasks: int = 0, **how) -> dict[str, DataFrame]:
    """documents(doc_id, text) -> tables under ``path``; ``how`` goes to ``text.sentences`` (plug-ins and so on).

    * documents(doc_id), those that were given;
    * sentences(doc_id, sent_id, sentence, terms), by range of doc_id;
    * postings(term, doc_id, sent_ids), by range of term and doc_id, so that a
      question's terms read few row groups and a frequent term is many ranges.
    """
    write_split(docs, path, tasks, **how)
    write_postings(docs.sparkSession, path)
    return load(docs.sparkSession, path)


def write_split(docs: DataFrame, path: str, tasks: int = 0, **how) -> dict[str, DataFrame]:
    """The tables documents and sentences of ``build``, which many questions need alone; ``write_postings`` adds the third.

    ``tasks`` is a number of files that grows with the documents, so that a task's share does not.
    """
    spark = docs.sparkSession
    docs.select("doc_id").write.mode("overwrite").parquet(f"{path}/documents")
    # The documents are dealt, not their sentences: dealing by range samples what it deals, and would split every text twice.
    dealt = docs.repartitionByRange(max(files_of(spark), tasks), "doc_id").sortWithinPartitions("doc_id")
    split = sentences(dealt, **how).withColumn("terms", F.array_distinct(token_array(F.col("sentence"))))
    split.write.option("compression", CODEC).mode("overwrite").parquet(f"{path}/sentences")
    return load(spark, path, TABLES[:2])


#: Sentences and their terms are texts twice over, which this codec makes small.
CODEC = "zstd"


def files_of(spark: SparkSession) -> int:
    """Files of each table, which later scans share out."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write(docs: DataFrame, split: DataFrame, path: str) -> None:
    """docs(doc_id) and split(doc_id, sent_id, sentence, terms), a written table, as the tables of ``build``."""
    spark = docs.sparkSession
    docs.select("doc_id").write.mode("overwrite").parquet(f"{path}/documents")
    dealt = split.repartitionByRange(files_of(spark), "doc_id", "sent_id").sortWithinPartitions("doc_id", "sent_id")
    dealt.write.option("compression", CODEC).mode("overwrite").parquet(f"{path}/sentences")
    write_postings(spark, path)


def write_dealt(docs: DataFrame, dealt, held: int, path: str) -> None:
    """docs(doc_id) and ``dealt`` (a number of tasks -> (doc_id, sent_id, sentence) by range of doc_id) as the tables of ``build``; ``held`` is the bytes of the sentences' files.

    Terms are made after the dealing, which then has each text once.
    """
    spark = docs.sparkSession
    docs.select("doc_id").write.mode("overwrite").parquet(f"{path}/documents")
    rows = dealt(max(files_of(spark), -(-held // POSTING_BYTES))).sortWithinPartitions("doc_id", "sent_id")
    rows.withColumn("terms", F.array_distinct(token_array(F.col("sentence")))).write.option("compression", CODEC).mode("overwrite").parquet(f"{path}/sentences")
    write_postings(spark, path)


#: Bytes of stored sentences whose postings are one file, and one task's.
POSTING_BYTES = 8 << 20


def write_postings(spark: SparkSession, path: str) -> None:
    """The postings of the stored sentences: dealt once, by the range that they are stored in, where those of a document's term meet."""
    parts = max(files_of(spark), -(-size(spark, f"{path}/sentences") // POSTING_BYTES))
    stored = spark.read.parquet(f"{path}/sentences").select("doc_id", "sent_id", F.explode("terms").alias("term"))
    dealt = stored.repartitionByRange(parts, "term", "doc_id")
    posts = dealt.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("sent_id")).alias("sent_ids"))  # those of one document
    posts.sortWithinPartitions("term", "doc_id").write.option("compression", CODEC).mode("overwrite").parquet(f"{path}/postings")


def load(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables of an index; raises FileNotFoundError where one was not written to its end."""
    for name in names:
        if not exists(spark, f"{path}/{name}/_SUCCESS"):
            raise FileNotFoundError(f"no table {name} under {path}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def postings(index: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """(doc_id, term, sent_ids) of a question's terms; the filter reaches the scan."""
    return index["postings"].where(F.col("term").isin(*terms)).select("doc_id", "term", "sent_ids")
