"""Ranked retrieval with early end: BM25 from stored impact blocks.

Units (documents, or sentences) of like length are dealt to blocks of about
BLOCK.  A row of the postings is one term in one block, with each unit's term
frequency and length; beside it stands the largest impact there, which a table
of its own repeats.  A question adds up the largest impacts of its terms to a
bound for each block, scores the blocks with the highest bounds, and goes on only
with blocks whose bound reaches the score of the k-th unit found so far.  No
text is read, and bounds, blocks and scores stay in tables; the driver sees the
k best and the numbers of at most a wave's blocks.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.index import CODEC
from ..sources.shared import discard, exists, materialize, small_side
from ..sources.shared import size as bytes_of
from .keyword import K1, B

#: Units of a block, about, and classes of lengths for each doubling.
BLOCK, CLASSES = 128, 4
#: Blocks of the first waves; the last one takes all that can still matter.
WAVES = (32, 256)
#: Ranges of block numbers that a scan is given.
RANGES = 16
#: Units that are counted at a time.
ROWS = 128
#: Digits of a score; bounds are taken larger by one unit of them.
DIGITS = 4
#: Bytes of a row group of the postings, small, so that scans skip by term and block.
GROUP_BYTES = 1 << 20
#: Bytes of written counts whose postings are one file, and one task's.
COUNT_BYTES = 8 << 20
TABLES = ("postings", "maxima", "units", "stats")


def _impact(tf: Column, dl: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))


def _idf(n: int) -> Column:
    return F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def counted(units: DataFrame, keys: list[str]) -> DataFrame:
    """units(keys, terms) -> (key, dl, counts: array of (term, tf)), within the row, in Arrow batches."""
    given = units.select(F.struct(*keys).alias("key"), "terms")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                lists = batch.column("terms").to_pylist()
                found = [[{"term": t, "tf": n} for t, n in Counter(terms or ()).items()] for terms in lists]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(terms or ()) for terms in lists], pa.int32()), pa.array(found, kind)], names=["key", "dl", "counts"])

    return given.mapInArrow(run, f"key {given.schema['key'].dataType.simpleString()}, dl int, counts array<struct<term: string, tf: long>>")


def build(units: DataFrame, keys: list[str], path: str, block: int = BLOCK) -> dict[str, DataFrame]:
    """units(keys, terms: every token of the unit) -> tables under ``path``.

    * units(key, dl, block), stats(units, average): lengths, the number of units and their mean;
    * postings(term, block, hits, most), by range of term and block: hits has (key, tf, dl) of a block's units;
    * maxima(term, block, n, most): the units of a row of postings and the largest impact among them.

    A block is a class of lengths and a share of it by hash, so that a unit's
    block follows from its row; it has about ``block`` units.  The postings
    are dealt by one shuffle, by the range that they are stored in.
    """
    spark = units.sparkSession
    rows = materialize(counted(units, keys), "unit-counts")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_of(spark, rows.materialized_at) // COUNT_BYTES))
    size = F.floor(CLASSES * F.log2(1.0 + F.col("dl"))).cast("int")
    classes = rows.groupBy(size.alias("class")).agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()  # CLASSES for each doubling
    n, total = sum(r["n"] for r in classes), sum(r["dl"] for r in classes)
    average = total / n if n else 0.0
    shares = F.create_map(*[F.lit(x) for r in classes for x in (r["class"], max(1, r["n"] // block))]) if classes else F.create_map(F.lit(0), F.lit(1))
    number = size.cast("long") * (1 << 40) + F.pmod(F.xxhash64("key"), F.element_at(shares, size).cast("long"))
    placed = rows.select("key", "dl", number.alias("block"), "counts")
    placed.select("key", "dl", "block").write.mode("overwrite").parquet(f"{path}/units")
    spark.createDataFrame([(n, average)], "units long, average double").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    each = placed.select("block", "key", "dl", F.explode("counts").alias("x")).select("x.term", "block", "key", "x.tf", "dl")
    hits = F.sort_array(F.collect_list(F.struct("key", "tf", "dl")))  # of one block
    near = each.repartitionByRange(parts, "term", "block").groupBy("term", "block").agg(hits.alias("hits"), F.max(_impact(F.col("tf"), F.col("dl"), average)).alias("most"))
    near.sortWithinPartitions("term", "block").write.option("parquet.block.size", GROUP_BYTES).option("compression", CODEC).mode("overwrite").parquet(f"{path}/postings")
    discard(rows)
    spark.read.parquet(f"{path}/postings").select("term", "block", F.size("hits").cast("long").alias("n"), "most").write.mode("overwrite").parquet(f"{path}/maxima")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of impacts; raises FileNotFoundError where one was not written to its end."""
    for name in TABLES:
        if not exists(spark, f"{path}/{name}/_SUCCESS"):
            raise FileNotFoundError(f"no table {name} under {path}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def _within(blocks: list[int]) -> Column:
    """A filter on ``block`` that scans can use: at most RANGES ranges that cover the blocks."""
    blocks = sorted(blocks)
    gaps = sorted(range(1, len(blocks)), key=lambda i: blocks[i - 1] - blocks[i])[: RANGES - 1]
    starts = [0, *sorted(gaps), len(blocks)]
    runs = [(blocks[a], blocks[b - 1]) for a, b in zip(starts, starts[1:])]
    return reduce(lambda x, y: x | y, [F.col("block").between(a, b) for a, b in runs])


def scores(tables: dict[str, DataFrame], terms: list[str], within: Column | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(key, score) of units with a term; only where ``within`` holds and, if given, in ``blocks`` (a table of numbers)."""
    n, average = tables["stats"].first()
    frequency = tables["maxima"].where(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("n").alias("df"))  # a row for each term of the question
    rows = tables["postings"].where(F.col("term").isin(*terms))
    if within is not None:
        rows = rows.where(within)
    if blocks is not None:
        rows = rows.join(small_side(blocks), "block", "left_semi")
    hits = rows.select("term", F.explode("hits").alias("x")).select("term", "x.*").join(F.broadcast(frequency), "term")
    return hits.groupBy("key").agg(F.round(F.sum(_idf(n) * _impact(F.col("tf"), F.col("dl"), average)), DIGITS).alias("score"))


def bounds(tables: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """(block, bound): what a unit of a block can score at most; blocks without a term have no row."""
    rows = tables["maxima"].where(F.col("term").isin(*terms))
    frequency = rows.groupBy("term").agg(F.sum("n").alias("df"))
    return rows.join(F.broadcast(frequency), "term").groupBy("block").agg(F.sum(_idf(tables["stats"].first()["units"]) * F.col("most")).alias("bound"))


def top(tables: dict[str, DataFrame], terms: list[str], k: int, waves: tuple[int, ...] = WAVES) -> tuple[DataFrame, dict[str, int]]:
    """((key, score, rank) of the k best units, ties by key; {"blocks", "read"}: blocks with a term, and those that were scored).

    Exact: a block is passed over only if its bound is below the k-th score.
    """
    spark = tables["stats"].sparkSession
    left = materialize(bounds(tables, terms), "bounds")
    blocks, read, best = left.count(), 0, []

    def take(found: DataFrame) -> None:
        nonlocal best, left
        rows = found.orderBy(F.col("score").desc(), "key").limit(k).collect()
        best = sorted([*best, *rows], key=lambda r: (-r["score"], r["key"]))[:k]
        if len(best) == k:
            left = left.where(F.col("bound") + 10.0**-DIGITS >= best[-1]["score"])

    for size in waves:
        numbers = [r["block"] for r in left.orderBy(F.col("bound").desc(), "block").limit(size).collect()]
        if not numbers:
            break
        read += len(numbers)
        left = left.where(~F.col("block").isin(*numbers))
        take(scores(tables, terms, _within(numbers) & F.col("block").isin(*numbers)))
    rest, first, last = left.agg(F.count("*"), F.min("block"), F.max("block")).first()
    if rest:
        read += rest
        take(scores(tables, terms, F.col("block").between(first, last), left.select("block")))
    schema = tables["units"].select("key").schema.add("score", "double")
    rows = spark.createDataFrame([(r["key"], r["score"]) for r in best], schema)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "key"))), {"blocks": blocks, "read": read}
