"""A stored index that takes a stream: runs, markers of deletion, and compaction.

Every micro-batch of documents becomes a run: its sentences by range of
document, and its changes (doc_id, deleted), one for each document.  A batch
that runs twice overwrites its run.  A document's rows are those of the last run
that names it; a null text deletes.  Compaction merges the base and the runs into
a new base, in the layout of ``sources.index``, which is valid once its last
table is complete; readers take the newest valid base and the runs after it, so
neither a stopped compaction nor one that runs again is seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.keyword import with_terms
from ..operators.text import sentences
from ..sources import index
from ..sources.shared import children, delete, exists, size

RUN, BASE = "run=", "base="


def ingest(stream: DataFrame, path: str, checkpoint: str, **how):
    """documents(doc_id, text), null texts deleting -> runs under ``path``; processes what is there and ends.

    Of several rows of an id in one batch the largest text counts.  ``how``
    goes to ``text.sentences``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        whole = batch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("text").alias("text"))
        at = f"{path}/{RUN}{batch_id}"
        delete(spark, at)
        split = sentences(whole.where("trim(text) <> ''"), **how)
        split.write.option("compression", index.CODEC).parquet(f"{at}/sentences")
        # Of a text that is not blank its first other character tells its order among blank ones, so no text is dealt again.
        heads = batch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.regexp_extract("text", "^ *[^ ]?", 0)).alias("text"))
        heads.select("doc_id", F.coalesce(F.trim("text") == "", F.lit(True)).alias("deleted")).write.parquet(f"{at}/changes")  # last: its end makes the run valid

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _valid(spark: SparkSession, path: str, kind: str, last: str) -> list[int]:
    """The numbers of the runs or bases that were written to their end."""
    numbers = [int(name.removeprefix(kind)) for name in children(spark, path) if name.startswith(kind)]
    return sorted(n for n in numbers if exists(spark, f"{path}/{kind}{n}/{last}/_SUCCESS"))


def _state(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(the newest base, -1 for none, and the runs after it)."""
    bases = _valid(spark, path, BASE, index.TABLES[-1])
    base = bases[-1] if bases else -1
    return base, [n for n in _valid(spark, path, RUN, "changes") if n > base]


def _each(spark: SparkSession, path: str, base: int, runs: list[int], name: str) -> DataFrame | None:
    out = None
    for n in runs:
        rows = spark.read.parquet(f"{path}/{RUN}{n}/{name}").withColumn("run", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    return out


def current(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents(doc_id) and sentences(doc_id, sent_id, sentence, terms) as they stand; raises FileNotFoundError without a base or run."""
    base, runs = _state(spark, path)
    if base < 0 and not runs:
        raise FileNotFoundError(f"no live index under {path}")
    old = index.load(spark, f"{path}/{BASE}{base}") if base >= 0 else None
    if not runs:
        return {name: old[name] for name in ("documents", "sentences")}
    last = _each(spark, path, base, runs, "changes").groupBy("doc_id").agg(F.max(F.struct("run", "deleted")).alias("x")).select("doc_id", "x.run", "x.deleted")
    documents = last.where("NOT deleted").select("doc_id")
    sents = with_terms(_each(spark, path, base, runs, "sentences")).join(last.where("NOT deleted").select("doc_id", "run"), ["doc_id", "run"], "left_semi").drop("run")
    if old is not None:
        documents = documents.unionByName(old["documents"].join(last, "doc_id", "left_anti"))
        sents = sents.unionByName(old["sentences"].join(last, "doc_id", "left_anti"))
    return {"documents": documents, "sentences": sents}


def postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """(doc_id, term, sent_ids) as they stand: those of the base without changed documents, and those of the runs; ``terms`` reach the scans."""
    base, runs = _state(spark, path)
    wanted = lambda df: df if terms is None else df.where(F.col("term").isin(*terms))
    old = wanted(index.load(spark, f"{path}/{BASE}{base}")["postings"].select("doc_id", "term", "sent_ids")) if base >= 0 else None
    if not runs:
        if old is None:
            raise FileNotFoundError(f"no live index under {path}")
        return old
    last = _each(spark, path, base, runs, "changes").groupBy("doc_id").agg(F.max(F.struct("run", "deleted")).alias("x")).select("doc_id", "x.run", "x.deleted")
    fresh = with_terms(_each(spark, path, base, runs, "sentences")).join(last.where("NOT deleted").select("doc_id", "run"), ["doc_id", "run"], "left_semi")
    new = wanted(fresh.select("doc_id", "sent_id", F.explode("terms").alias("term"))).groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("sent_id")).alias("sent_ids"))
    return new if old is None else new.unionByName(old.join(last, "doc_id", "left_anti"))


def _merged(spark: SparkSession, path: str, base: int, runs: list[int], parts: int) -> DataFrame:
    """(doc_id, sent_id, sentence) as they stand, by range of doc_id: sentences and changes are dealt together, once, and those of a document's last run stay."""
    none = lambda df: df.select("doc_id", F.lit(None).cast("int").alias("sent_id"), F.lit(None).cast("string").alias("sentence"), "run")
    rows = _each(spark, path, base, runs, "sentences").select("doc_id", "sent_id", "sentence", "run").unionByName(none(_each(spark, path, base, runs, "changes")))
    if base >= 0:
        rows = rows.unionByName(index.load(spark, f"{path}/{BASE}{base}", index.TABLES[:2])["sentences"].select("doc_id", "sent_id", "sentence", F.lit(base).alias("run")))
    last = F.max("run").over(Window.partitionBy("doc_id"))  # a document's rows
    return rows.repartitionByRange(parts, "doc_id").withColumn("last", last).where("run = last AND sentence IS NOT NULL").select("doc_id", "sent_id", "sentence")


def compact(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Base and runs become a new base, whose number is the last run's; older ones go.  Without a new run nothing changes."""
    base, runs = _state(spark, path)
    if runs:
        made = f"{path}/{BASE}{runs[-1]}"
        delete(spark, made)
        index.write_dealt(current(spark, path)["documents"], lambda parts: _merged(spark, path, base, runs, parts), sum(size(spark, f"{path}/{RUN}{n}/sentences") for n in runs), made)
        for n in _valid(spark, path, RUN, "changes"):
            if n <= runs[-1]:
                delete(spark, f"{path}/{RUN}{n}")
        if base >= 0:
            delete(spark, f"{path}/{BASE}{base}")
        base = runs[-1]
    return index.load(spark, f"{path}/{BASE}{base}")
