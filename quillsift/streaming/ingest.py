"""Incremental ingest: new files become sentences, postings and representatives.

Each micro-batch is appended under its batch id, so a batch that runs twice
overwrites itself.  A document's sentences and postings come whole in one batch,
and readers take its latest version; a representative's vectors may come in many
batches, so each writes partial sums, and readers add up those of all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.keyword import postings
from ..operators.text import sentences
from ..operators.vectors import doubles


def stream_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_documents(stream: DataFrame, out: str, checkpoint: str):
    """documents(doc_id, text) -> tables sentences and postings under ``out``; processes what is there and ends."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sents = sentences(batch.select("doc_id", "text"))
        sents.write.mode("overwrite").parquet(f"{out}/sentences/batch={batch_id}")
        postings(sents).write.mode("overwrite").parquet(f"{out}/postings/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_representatives(stream: DataFrame, out: str, checkpoint: str):
    """(doc, vector) -> table reps under ``out``: (doc, i, total, n), each batch's sums and counts by dimension."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = batch.select("doc", F.posexplode(doubles(F.col("vector"))).alias("i", "x"))
        parts.groupBy("doc", "i").agg(F.sum("x").alias("total"), F.count("x").alias("n")).write.mode("overwrite").parquet(f"{out}/reps/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of each key's latest batch."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"])


def representatives(spark: SparkSession, path: str) -> DataFrame:
    """(doc, rep): the mean of a document's vectors of all batches, from the table reps."""
    means = spark.read.parquet(path).groupBy("doc", "i").agg((F.sum("total") / F.sum("n")).alias("x"))
    return means.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("rep"))
