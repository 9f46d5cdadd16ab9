"""Sources and sinks: documents as files, and the tables of an index.

Files are read with Spark's readers, so any store that Spark knows will do.
Rows carry their document's number, which replaces the pairing of files by
sorted names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import file_number, html_lines
from .shared import kept, size

STEM = r"([^/]+?)(\.[^./]*)?$"
#: Files that write_named made have their name in their folder's.
NAMED = r"/name=([^/]+)/[^/]*$"


def stem(path) -> F.Column:
    """A file's name without its ending, or the name that write_named gave it."""
    named = F.regexp_extract(path, NAMED, 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(path, STEM, 1))


#: Names of an export; a store's table of names is no place for a corpus.
MOST_FILES = 100_000


def write_lines(df: DataFrame, path: str) -> None:
    """(name, text) -> JSON lines, many texts to a file."""
    df.select("name", "text").write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_lines`` wrote, as (doc_id, text): doc_id is the first number in the name."""
    rows = spark.read.schema("name string, text string").json(path)
    return rows.select(file_number(F.col("name")).alias("doc_id"), "text")


def write_named(df: DataFrame, path: str) -> None:
    """(name, text) -> an export: a file for each name under ``path`` (in a folder name=...), which ends in a line end.

    More than MOST_FILES names raise; ``write_lines`` takes any number.
    """
    if df.select("name").distinct().limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"an export has at most {MOST_FILES} files")
    df.select("name", "text").repartition("name").sortWithinPartitions("name").write.mode("overwrite").partitionBy("name").text(path)


#: Bytes of the files that a task takes, and of the texts in them: equal texts may be one in a file, but each is counted by itself.
PART_BYTES, TEXT_BYTES = 8 << 20, 16 << 20


def spread(df: DataFrame, path: str, key: str) -> DataFrame:
    """``df``, read from ``path``, dealt by ``key`` over all cores, in shares of at most about PART_BYTES and TEXT_BYTES.

    A task's share does not grow with the file, and what is grouped by ``key``
    (and more) afterwards needs no shuffle of its own.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, shares(df, path)), key)


def shares(df: DataFrame, path: str) -> int:
    """Tasks of at most about PART_BYTES of a file or folder each, and TEXT_BYTES of its texts (counted once for a state of it)."""
    spark = df.sparkSession
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]

    def count():
        total = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in texts), F.lit(0).cast("long"))
        return {"bytes": df.agg(F.sum(total)).first()[0] or 0}

    held = kept(spark, path, f"bytes of {texts}", count)["bytes"] if texts else 0
    return max(-(-size(spark, path) // PART_BYTES), -(-held // TEXT_BYTES))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files -> (doc_id, text): doc_id is the first number in the file's name."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(file_number(stem(F.col("_metadata.file_path"))).alias("doc_id"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Binary files (PDF, HTML) -> (doc_id, page, line_no, line).

    ``parse`` gives a file's pages as texts, one block to a line; without it
    the files are taken for HTML of a single page.
    """
    files = spark.read.format("binaryFile").load(path).select(file_number(stem(F.col("path"))).alias("doc_id"), "content")
    if parse is None:
        return page_lines(files.select("doc_id", F.col("content").cast("string").alias("text")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                raw = batch.column("content")[i].as_py()
                texts = parse(raw) if raw is not None else []
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id")[i].as_py()] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "page", "text"])

    rows = files.mapInArrow(run, "doc_id long, page int, text string")
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    return rows.select("doc_id", "page", F.posexplode(lines).alias("line_no", "line"))


def page_lines(texts: DataFrame) -> DataFrame:
    """(doc_id, text: HTML of a single page) -> (doc_id, page, line_no, line)."""
    return texts.select("doc_id", F.lit(0).alias("page"), F.posexplode(html_lines(F.col("text"))).alias("line_no", "line"))


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON maps term -> sentence ids, a file for each document -> (doc_id, term, postings)."""
    return parsed_index(read_texts(spark, path))


def parsed_index(texts: DataFrame) -> DataFrame:
    """(doc_id, text: a JSON map term -> sentence ids) -> (doc_id, term, postings)."""
    return texts.select("doc_id", F.explode(F.from_json("text", "map<string,array<int>>")).alias("term", "postings"))


def index_json(index: DataFrame) -> DataFrame:
    """(doc_id, term, postings) -> (doc_id, json), the export view of one document's index."""
    return index.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "postings"))))).alias("json"))


def write_table(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    """Parquet; ``sort_by`` orders rows within files, so that readers skip row groups by its range."""
    (df.sortWithinPartitions(sort_by) if sort_by else df).write.mode("overwrite").parquet(path)


def unpaired(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that only one of two tables has: the check that replaces an equal count of files."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))
