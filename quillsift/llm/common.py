"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize, small_side

__all__ = ["discard", "materialize", "small_batches", "small_side", "slices", "table", "text_hash60", "text_slices"]

#: Rows of an Arrow batch that holds texts, and bounds of the slices in which a Python worker goes through it.
BATCH_ROWS = 1000
SLICE_ROWS, SLICE_CHARS = 256, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to BATCH_ROWS, so that neither side of a worker's pipe holds many texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def slices(lengths, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS):
    """(start, stop) of successive slices of texts of these lengths (None: null); a longer text is a slice of its own end."""
    start = total = 0
    for i, length in enumerate(lengths):
        total += length or 0
        if i + 1 - start == rows or total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(batch, column: str):
    """Slices of an Arrow batch, cut by the lengths of a string column, each with its texts as a list."""
    import pyarrow.compute as pc

    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for start, stop in slices(lengths):
        part = batch.slice(start, stop - start)
        yield part, part.column(column).to_pylist()


def text_hash60(*cols) -> F.Column:
    """A 60-bit non-negative hash that other SQL engines can compute too (md5 prefix)."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")
