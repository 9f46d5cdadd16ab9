"""Representative vectors, exact nearest neighbours and two-stage search.

Tables have a row for each sentence: (doc, id, vector).  Arithmetic is in
doubles, and ranks break ties by id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import exists, materialize, small_side
from . import dense
from .text import let

VARIANCE = 0.99
MAX_DIM, MAX_K = 10, 10
#: Rows of one document that are taken in one task; those of a larger document are clustered where they are, in jobs.
GROUP_ROWS = 50_000
#: Rows of all documents that a task takes, about, and components that it works on at a time.
TASK_ROWS, CELLS = 100_000, 1 << 20
STEPS = 25
#: Questions that are broadcast at a time.
QUESTIONS = 1000
#: Bytes of moments that a task holds, and tasks over which a document's partial moments are dealt first.
MOMENT_BYTES, SALTS = 64_000_000, 32


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_squared(a: Column, b: Column) -> Column:
    same = F.when(F.size(a) == F.size(b), F.lit(0.0)).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))
    return same + F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def rep_mean(vectors: DataFrame) -> DataFrame:
    """(doc, rep): the mean vector, summed up by dimension on the map side."""
    parts = vectors.select("doc", F.posexplode(doubles(F.col("vector"))).alias("i", "x")).groupBy("doc", "i").agg(F.avg("x").alias("x"))
    return parts.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("rep"))


def _moments(vectors: DataFrame) -> DataFrame:
    """(doc, n, total, square): count, sum and sum of outer products of each document.

    A task adds up what comes together, within MOMENT_BYTES; a document's
    partial moments are added in two levels, so no task takes them all.
    """

    def run(batches):
        held: dict = {}

        def rows():
            return pd.DataFrame([(doc, n, t.tobytes(), s.tobytes()) for doc, (n, t, s) in held.items()], columns=["doc", "n", "total", "square"]).astype({"doc": "Int64"})

        for b in batches:
            for doc, part in b.groupby("doc", dropna=False):
                x = np.array(part["vector"].to_list(), dtype=np.float64)
                n, t, s = held.get(doc, (0, 0.0, 0.0))
                held[doc] = (n + len(x), t + x.sum(axis=0), s + x.T @ x)
                if 8 * x.shape[1] ** 2 * len(held) > MOMENT_BYTES:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    def add(key, part):
        total, square = (sum(np.frombuffer(v) for v in part[c]).tobytes() for c in ("total", "square"))
        return pd.DataFrame([(key[0], part["n"].sum(), total, square)], columns=["doc", "n", "total", "square"])

    schema = "doc long, n long, total binary, square binary"
    parts = vectors.select(F.col("doc").cast("long").alias("doc"), doubles(F.col("vector")).alias("vector")).mapInPandas(run, schema)
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("doc", "salt").applyInPandas(add, schema)
    return salted.groupBy("doc").applyInPandas(add, schema)


def _principal(n: int, total: bytes, square: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, variances from the largest, axes as columns) of a document's moments."""
    mean = np.frombuffer(total) / n
    d = len(mean)
    values, axes = np.linalg.eigh(np.frombuffer(square).reshape(d, d) / n - np.outer(mean, mean))
    return mean, np.maximum(values[::-1], 0), axes[:, ::-1]


def rep_adaptive_pca(vectors: DataFrame, variance: float = VARIANCE) -> DataFrame:
    """(doc, dim, rep): ``dim`` is the smallest number of principal components that hold the share ``variance``.

    ``rep`` is the mean of the PCA scores, transformed back; centred scores
    have mean zero, so it is the mean vector.  Components come from partial
    moments, so no document has to fit into one task.
    """

    def of(x):
        mean = x.mean(axis=1)
        values = np.linalg.svd(x - mean[:, None], compute_uv=False) ** 2 / x.shape[1]
        return [_dim(v, x.shape[1], variance, x.shape[2]) for v in values], mean

    def finish(batches):
        for b in batches:
            rows = []
            for doc, n, total, square in b.itertuples(index=False):
                mean, values, _ = _principal(n, total, square)
                rows.append((doc, _dim(values, n, variance, len(mean)), mean.tolist()))
            yield pd.DataFrame(rows, columns=["doc", "dim", "rep"])

    schema = "doc long, dim int, rep array<double>"
    rows = vectors.select(F.col("doc").cast("long").alias("doc"), doubles(F.col("vector")).alias("vector")).where("vector IS NOT NULL")
    fits, large, _ = _by_size(rows)
    out = _by_document(*fits, of, "dim")
    return out if large is None else out.unionByName(_moments(large).mapInPandas(finish, schema))


def _dim(values: np.ndarray, n: int, variance: float, width: int) -> int:
    """The smallest number of components that hold the share ``variance``; 1 where nothing varies."""
    whole = values.sum()
    return int(min(np.searchsorted(np.cumsum(values) / whole, variance) + 1, width)) if whole > 1e-12 and n > 1 else 1


def _by_size(rows: DataFrame) -> tuple[tuple[DataFrame, int], DataFrame | None, DataFrame | None]:
    """rows(doc, vector) as ((those of documents of up to GROUP_ROWS rows, tasks for them), those of larger documents, their sizes(doc, n)); None for no larger ones."""
    sizes = rows.groupBy("doc").agg(F.count("*").alias("n"))
    most, whole = sizes.agg(F.max("n"), F.sum("n")).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(whole or 0) // TASK_ROWS))
    if (most or 0) <= GROUP_ROWS:
        return (rows, tasks), None, None
    large = materialize(sizes.where(F.col("n") > GROUP_ROWS), "large-docs")
    ids = small_side(large.select(F.col("doc").alias("large")))
    same = F.col("doc").eqNullSafe(F.col("large"))
    return (rows.join(ids, same, "left_anti"), tasks), rows.join(ids, same, "left_semi"), large


def _by_document(rows: DataFrame, tasks: int, of, number: str) -> DataFrame:
    """(doc, ``number``, rep): ``of`` gives numbers and representatives of an array documents x rows x components.

    A task takes its documents in order, many at a time: those with equally
    many rows are one array, of about CELLS components.
    """

    def whole(batches):
        """(doc, its rows), a document at a time."""
        last, parts = None, []
        for batch in batches:
            ids, lists = batch.column("doc").to_pylist(), batch.column("vector")
            values, widths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(widths)])
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if (widths[a:b] != widths[a]).any():
                    raise ValueError("vectors differ in dimension")
                if parts and ids[a] != last:
                    yield last, np.concatenate(parts)
                    parts = []
                last = ids[a]
                parts.append(values[ends[a] : ends[b]].reshape(b - a, -1))
        if parts:
            yield last, np.concatenate(parts)

    def run(batches):
        import pyarrow as pa

        def made(held):
            alike: dict = {}
            for doc, x in held:
                alike.setdefault(x.shape, []).append((doc, x))
            for group in alike.values():
                numbers, reps = of(np.stack([x for _, x in group]))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(reps) + 1) * reps.shape[1], pa.int32()), pa.array(reps.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([doc for doc, _ in group], pa.int64()), pa.array(numbers, pa.int32()), flat], names=["doc", number, "rep"])

        held, cells = [], 0
        for doc, x in whole(batches):
            held.append((doc, x))
            cells += x.size
            if cells > CELLS:
                yield from made(held)
                held, cells = [], 0
        yield from made(held)

    return rows.repartition(tasks, "doc").sortWithinPartitions("doc").mapInArrow(run, f"doc long, {number} int, rep array<double>")


def elbow(sse: list[float], first: int = 2) -> int:
    """The k right after the largest drop of the error."""
    return first if len(sse) < 2 else first + 1 + int(np.argmin(np.diff(sse)))


def kmeans(x: np.ndarray, k: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Lloyd's steps from evenly spaced rows in order of the first component: (labels, centres, error)."""
    centres = x[np.argsort(x[:, 0], kind="stable")[np.linspace(0, len(x) - 1, k).astype(int)]]
    for _ in range(steps):
        far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        labels = far.argmin(axis=1)
        new = np.stack([x[labels == i].mean(axis=0) if (labels == i).any() else centres[i] for i in range(k)])
        if np.array_equal(new, centres):
            break
        centres = new
    far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    return far.argmin(axis=1), centres, float(far.min(axis=1).sum())


def kmeans_of_each(x: np.ndarray, k: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``kmeans`` of every matrix of an array documents x rows x components, all at once."""
    first = np.argsort(x[:, :, 0], axis=1, kind="stable")[:, np.linspace(0, x.shape[1] - 1, k).astype(int)]
    centres = np.take_along_axis(x, first[:, :, None], axis=1)

    def near(x, centres):
        far = np.stack([((x - centres[:, i : i + 1]) ** 2).sum(axis=2) for i in range(k)], axis=2)
        return far.argmin(axis=2), far.min(axis=2).sum(axis=1)

    moving = np.arange(len(x))
    for _ in range(steps):
        part, old = x[moving], centres[moving]
        member = (near(part, old)[0][:, None] == np.arange(k)[:, None]).astype(float)
        sizes = member.sum(axis=2, keepdims=True)
        new = np.where(sizes > 0, member @ part / np.maximum(sizes, 1), old)
        centres[moving] = new
        moving = moving[(new != old).any(axis=(1, 2))]
        if not len(moving):
            break
    labels, errors = near(x, centres)
    return labels, centres, errors


def _candidates(n: int) -> range:
    """Numbers of clusters that are tried for n rows; the elbow chooses."""
    most = min(MAX_K, n) - 1
    return range(1, 2) if most < 2 else range(2, most + 1)


def rep_pca_kmeans(vectors: DataFrame) -> DataFrame:
    """(doc, k, rep): cluster centres of the PCA scores, weighted by size and transformed back.

    Documents of up to GROUP_ROWS sentences are clustered many to a task, the
    others by the same steps as jobs over all their rows (``_spread_clusters``).
    Rows with a null document or vector take no part.
    """

    def of(x):
        mean = x.mean(axis=1)
        axes = np.linalg.svd(x - mean[:, None], full_matrices=False)[2][:, : min(MAX_DIM, *x.shape[1:])]
        scores = (x - mean[:, None]) @ axes.transpose(0, 2, 1)
        tried = _candidates(x.shape[1])
        found = [kmeans_of_each(scores, c) for c in tried]
        best = [0 if len(tried) == 1 else elbow(list(errors)) - tried[0] for errors in np.stack([error for _, _, error in found], axis=1)]
        reps = []
        for i, at in enumerate(best):
            k, labels = tried[at], found[at][0][i]
            sizes = np.bincount(labels, minlength=k)
            centres = (labels == np.arange(k)[:, None]).astype(float) @ scores[i] / np.maximum(sizes, 1)[:, None]
            reps.append(mean[i] + np.average(centres, axis=0, weights=sizes) @ axes[i])
        return [tried[at] for at in best], np.stack(reps)

    rows = vectors.select(F.col("doc").cast("long").alias("doc"), doubles(F.col("vector")).alias("vector")).where("doc IS NOT NULL AND vector IS NOT NULL")
    fits, large, sizes = _by_size(rows)
    out = _by_document(*fits, of, "k")
    return out if large is None else out.unionByName(_spread_clusters(large, sizes))


def _spread_clusters(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc, k, rep) of large documents(doc, vector), sizes(doc, n): Lloyd's steps in SQL for all candidates at once.

    A document's centres, at most MAX_K squared of MAX_DIM numbers, are one
    row, which its rows are joined with; sums by cluster are partial on the map
    side.  The first centres are rows at even places in order of the first
    component, found by ranges.
    """

    def axes_of(batches):
        for b in batches:
            out = []
            for doc, n, total, square in b.itertuples(index=False):
                mean, _, axes = _principal(n, total, square)
                out.append((doc, mean.tolist(), axes[:, : min(MAX_DIM, n)].T.tolist()))
            yield pd.DataFrame(out, columns=["doc", "mean", "axes"])

    axes = materialize(_moments(rows).mapInPandas(axes_of, "doc long, mean array<double>, axes array<array<double>>"), "axes")
    centred = F.zip_with("vector", "mean", lambda x, m: x - m)
    scores = rows.join(small_side(axes), "doc").select("doc", centred.alias("v"), "axes").select("doc", F.transform("axes", lambda a: dot(F.col("v"), a)).alias("s"))
    ordered = materialize(scores.repartitionByRange("doc", F.col("s")[0]).withColumn("part", F.spark_partition_id()), "scores")
    parts = ordered.groupBy("doc", "part").agg(F.count("*").alias("c"))
    start = F.coalesce(F.sum("c").over(Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = parts.withColumn("start", start).drop("c")
    place = F.row_number().over(Window.partitionBy("doc", "part").orderBy(F.col("s")[0])) - 1 + F.col("start")
    tried = [k for k in range(1, MAX_K)]
    at = sizes.select("doc", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.floor(F.lit(i) * (F.col("n") - 1) / max(1, k - 1)).cast("long").alias("at")) for k in tried if k > 1 for i in range(k)])).alias("x")).select("doc", "x.*")
    wanted = ordered.join(small_side(begin), ["doc", "part"]).withColumn("at", place).join(small_side(at), ["doc", "at"]).select("doc", "k", "i", "s")
    nest = lambda df: df.groupBy("doc", "k").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("cs")).groupBy("doc").agg(F.collect_list(F.struct("k", F.transform("cs", lambda c: c["s"]).alias("cs"))).alias("ks"))
    centres = materialize(nest(wanted), "centres")
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    nearest_of = lambda s, cs: F.array_min(F.transform(cs, lambda c, i: F.struct(far(s, c).alias("d"), i.alias("i"))))

    def labelled(now: DataFrame) -> DataFrame:
        row = ordered.join(small_side(now), "doc").select("doc", "s", F.explode("ks").alias("x"))
        return row.select("doc", "s", F.col("x.k").alias("k"), nearest_of(F.col("s"), F.col("x.cs")).alias("m"))

    for _ in range(STEPS):
        sums = labelled(centres).select("doc", "k", F.col("m.i").alias("i"), F.posexplode("s").alias("j", "y")).groupBy("doc", "k", "i", "j").agg(F.avg("y").alias("y"))
        moved = sums.groupBy("doc", "k", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "y"))), lambda p: p["y"]).alias("t"))
        old = centres.select("doc", F.explode("ks").alias("x")).select("doc", "x.k", F.posexplode("x.cs").alias("i", "s"))
        both = materialize(old.join(moved, ["doc", "k", "i"], "left").select("doc", "k", "i", F.coalesce("t", "s").alias("s"), F.coalesce(F.col("t") != F.col("s"), F.lit(False)).alias("moved")), "moved")
        centres = materialize(nest(both), "centres")
        if both.where("moved").isEmpty():
            break
    errors = labelled(centres).groupBy("doc", "k").agg(F.sum("m.d").alias("sse"))
    return elbow_k(errors).select("doc", F.col("best_k").cast("int").alias("k")).join(rep_mean(rows), "doc")  # the weighted centre is the mean


def elbow_k(sse: DataFrame) -> DataFrame:
    """sse(doc, k, sse) -> (doc, best_k): the k after the largest drop; a single candidate is it."""
    drop = F.col("sse") - F.lag("sse").over(Window.partitionBy("doc").orderBy("k"))
    return sse.withColumn("drop", drop).groupBy("doc").agg(F.coalesce(F.min(F.when(F.col("drop").isNotNull(), F.struct("drop", "k")))["k"], F.min("k")).alias("best_k"))


def cluster_weights(rows: DataFrame, by: str) -> DataFrame:
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.groupBy(by).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("total"), 6).alias("weight"))


def rep_append(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (doc, version, rep): the latest version of each document."""
    return stored.unionByName(new).groupBy("doc").agg(F.max(F.struct("version", "rep")).alias("x")).select("doc", "x.version", "x.rep")


def in_blocks(query: DataFrame, ask) -> DataFrame:
    """``ask`` of every block of at most about QUESTIONS rows of a query set (query_id, q), one after the other."""
    blocks = max(1, -(-query.count() // QUESTIONS))
    if blocks == 1:
        return ask(F.broadcast(query))
    out = None
    for block in range(blocks):
        part = ask(F.broadcast(query.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)))
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(scored: DataFrame, k: int, key: str, ascending: bool = False) -> DataFrame:
    order = F.col("score").asc() if ascending else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, query: DataFrame, k: int, by=cosine, ascending: bool = False, key: str = "id") -> DataFrame:
    """(query_id, key, score, rank) of the k nearest rows for each query.

    ``query`` (query_id, q) is counted and taken in blocks; each task keeps its k
    best before anything is shuffled.  Where the score is a cosine, an inner
    product or a squared distance, and keys are whole numbers, candidates come
    from matrix products (``operators.dense``) and only they are scored here;
    rows with a null key are then left out.
    """
    metric = by.__name__
    if dense.takes(vectors, key, metric) and ascending == (metric == "l2_squared"):
        return _nearest_dense(vectors, query, k, by, ascending, key)

    def ask(part: DataFrame) -> DataFrame:
        return _ranked(vectors.select(key, F.col("vector").alias("v")).join(part).select("query_id", key, by(doubles(F.col("v")), F.col("q")).alias("score")), k, key, ascending)

    return in_blocks(query, ask)


def _nearest_dense(vectors: DataFrame, query: DataFrame, k: int, by, ascending: bool, key: str) -> DataFrame:
    kind = vectors.schema[key].dataType
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), doubles(F.col("vector")).alias("v"))
    blocks = max(1, -(-query.count() // QUESTIONS))
    out = None
    for block in range(blocks):
        part = (query if blocks == 1 else query.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).select("query_id", doubles(F.col("q")).alias("q"))
        asked = part.collect()  # a block of questions
        fine = [r for r in asked if r["q"] and all(x is not None and math.isfinite(x) for x in r["q"])]
        pieces = []
        for width in {len(r["q"]) for r in fine}:
            mine = [r for r in fine if len(r["q"]) == width]
            names = part.sparkSession.createDataFrame([(i, r["query_id"], r["q"]) for i, r in enumerate(mine)], part.select(F.lit(0).alias("query_row"), "query_id", "q").schema)
            found = dense.candidates(rows.where(dense.sound(F.col("v"), width)), [r["q"] for r in mine], k, by.__name__, key).join(F.broadcast(names), "query_row")
            odd = rows.where(~dense.sound(F.col("v"), width)).join(F.broadcast(names.drop("query_row")))
            pieces += [found.select("query_id", key, "v", "q"), odd.select("query_id", key, "v", "q")]
        rest = [r for r in asked if r not in fine]
        if rest or not pieces:
            pieces.append(rows.join(F.broadcast(part.sparkSession.createDataFrame([(r["query_id"], r["q"]) for r in rest], part.schema))).select("query_id", key, "v", "q"))
        for piece in pieces:
            out = piece if out is None else out.unionByName(piece)
    return _ranked(out.select("query_id", F.col(key).cast(kind).alias(key), by(F.col("v"), F.col("q")).alias("score")), k, key, ascending)


def two_stage(vectors: DataFrame, reps: DataFrame, query: DataFrame, docs: int, sentences: int, by=cosine, carry: tuple[str, ...] = ()) -> DataFrame:
    """The best sentences of every question's best documents: (query_id, doc, id, rank, score), and columns of the sentences in ``carry``.

    A block's documents, at most QUESTIONS * docs, are broadcast, which cuts
    the sentences where they are scanned.  Of stored sentences (``load_sentences``)
    only the buckets of those documents are read, which Spark finds as it runs.
    """
    stored = BUCKET in vectors.columns
    keys = [BUCKET, "doc"] if stored else ["doc"]

    def ask(part: DataFrame) -> DataFrame:
        best = nearest(reps.select(F.col("doc").alias("id"), F.col("rep").alias("vector")), part, docs, by).select("query_id", F.col("id").alias("doc"))
        if stored:
            best = best.withColumn(BUCKET, bucket_of(F.col("doc"), vectors.buckets))
        chosen = vectors.join(F.broadcast(best), keys).join(part, "query_id")
        return _ranked(chosen.select("query_id", "doc", "id", *carry, by(doubles(F.col("vector")), F.col("q")).alias("score")), sentences, "id")

    return in_blocks(query, ask).select("query_id", "doc", "id", "rank", "score", *carry)


BUCKET = "doc_bucket"
#: Folders of stored sentences; a question's documents are in a few of them.
BUCKETS = 64


def bucket_of(doc: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc.cast("long")), F.lit(buckets)).cast("int")


def write_sentences(vectors: DataFrame, path: str, buckets: int = BUCKETS, count: int = 0) -> None:
    """(doc, id, vector, any more) -> a folder for each bucket of documents, rows by document.

    ``buckets`` is a number of folders that the store can list, and no more
    grows with the documents; a large bucket is several files.  ``count`` is
    about the number of rows, so that a task's share does not grow with it.
    """
    rows = vectors.withColumn(BUCKET, bucket_of(F.col("doc"), buckets))
    shares = -(-count // (TASK_ROWS * buckets))
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), shares * buckets)
    share = F.pmod(F.xxhash64(F.lit("share"), F.col("doc").cast("long")), F.lit(max(1, shares)))
    rows.repartition(tasks, BUCKET, share).sortWithinPartitions(BUCKET, "doc", "id").write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/buckets={buckets}")


def load_sentences(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored sentences; raises FileNotFoundError where they were not written to their end."""
    if not exists(spark, f"{path}/buckets={buckets}/_SUCCESS"):
        raise FileNotFoundError(f"no stored sentences under {path}")
    found = spark.read.parquet(f"{path}/buckets={buckets}")
    found.buckets = buckets
    return found


def write_reps(reps: dict[str, DataFrame], path: str) -> None:
    """method -> (doc, rep): the table reps(doc, rep) by method; a method's rows replace what it had."""
    for method, df in reps.items():
        df.select("doc", "rep").write.mode("overwrite").parquet(f"{path}/method={method}")


def load_reps(spark: SparkSession, path: str, method: str) -> DataFrame:
    """(doc, rep) of a method; raises FileNotFoundError where it was not written to its end."""
    if not exists(spark, f"{path}/method={method}/_SUCCESS"):
        raise FileNotFoundError(f"no representatives of {method} under {path}")
    return spark.read.parquet(f"{path}/method={method}")


def write_flat(vectors: DataFrame, path: str) -> None:
    """(id, vector) -> a flat index: vectors of unit length, by range of id."""
    vectors.select("id", normalized(doubles(F.col("vector"))).alias("vector")).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def load_flat(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of a flat index; raises FileNotFoundError where it was not written to its end."""
    if not exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"no flat index under {path}")
    return spark.read.parquet(path)
