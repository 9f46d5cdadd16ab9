"""The folder that all executors share, and tables that are kept in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table that was counted first is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000

_folders: set[str] = set()
_kept: dict[tuple, dict[str, DataFrame]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset, a session in one process (local, as in tests) gets a
    temporary one; on a cluster, whose machines would not see it, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillsift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _file_system(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is not there."""
    target, fs = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    target, fs = _file_system(spark, path)
    return fs.getContentSummary(target).getLength()


def state(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a file or folder from another: its files' names, lengths and times, as (number, bytes, hash).

    Files are listed by Spark; none is opened.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return tuple(listed.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


@atexit.register
def _clean_up() -> None:
    """At the end of the program the folders of intermediate tables go; where its JVM has ended before, they stay."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        for path in _folders:
            delete(spark, path)
    except (Py4JError, ConnectionError):
        return


def new_path(spark: SparkSession, tag: str) -> str:
    """A path for a table of this program, which goes when the program ends."""
    folder = f"{shared_dir(spark)}/quillsift/{spark.sparkContext.applicationId}"
    _folders.add(folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The written table outlives any executor, unlike cached blocks.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.materialized_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables; what was made of them must have been written before."""
    for df in tables:
        delete(df.sparkSession, df.materialized_at)


def kept(spark: SparkSession, source: str, tag: str, build) -> dict[str, DataFrame]:
    """The tables that ``build()`` gives, built once for a state of the source file or folder in this program."""
    key = (spark.sparkContext.applicationId, source, tag, state(spark, source))
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have few rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
