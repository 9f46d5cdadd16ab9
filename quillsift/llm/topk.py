"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are cut into BLOCKS nodes, each of which knows its own part of
every score; a score is the sum of its parts.  Rows are taken in chunks.

1. Every chunk gathers the local list of one node (in turn): the k candidates
   with the highest parts there.  What those candidates score in full gives a
   lower bound t of the k-th best score, for each query.  So this phase takes
   1 / BLOCKS of all parts.
2. A candidate that scores t or more has a part of t / BLOCKS or more on some
   node, whatever the signs.  This cutoff is broadcast.  Node by node, a chunk
   adds up parts and goes on with the entries that can still be sufficient:
   a part has reached the cutoff or a node to come can reach it, and the sum so
   far and the largest possible rest (products of lengths, by Cauchy-Schwarz)
   reach t.  Once few are left their parts are taken one by one.
3. What is left has its exact score; the best k stay.

Queries are taken in blocks of bounded size, which is what is broadcast; the
candidates stay where they are, and only k entries for each query and
partition are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

K = 5
SCALE = 256
BLOCKS = 4
#: Queries that are broadcast at a time.
QUERY_BLOCK = 8192
ROW_CHUNK = 256
#: Share of a chunk's entries below which parts are taken entry by entry.
FEW = 0.02


def quantize(vector) -> F.Column:
    """floor(SCALE * x) of each component as doubles; null if the vector, a component or its value is null or not finite."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(as_double, lambda x: F.floor(x * F.lit(float(SCALE))).cast("double")))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of equal width: shorter vectors are filled up with zeros."""
    if all(len(v) == width for v in vectors):
        return np.array(list(vectors), dtype=np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _dtype(queries: np.ndarray, rows: np.ndarray):
    """float32 while all sums are whole numbers below 2^24, else float64 (exact below 2^53)."""
    top = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    return np.float32 if top < 2**24 else np.float64


def _nodes(width: int) -> list[slice]:
    """The dimensions of each node."""
    cuts = np.linspace(0, width, BLOCKS + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _lengths(rows: np.ndarray) -> np.ndarray:
    """(nodes, rows): the length of every row's part, rounded up."""
    return np.stack([np.sqrt((rows[:, d] ** 2).sum(axis=1)) for d in _nodes(rows.shape[1])]) * (1 + 1e-9)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each column's k highest entries (more where ties must not be cut are not needed: a bound)."""
    k = min(k, scores.shape[0])
    return np.argpartition(scores, scores.shape[0] - k, axis=0)[scores.shape[0] - k :]


def _chunks(batches, width: int):
    for b in batches:
        for at in range(0, len(b), ROW_CHUNK):
            part = b.iloc[at : at + ROW_CHUNK]
            yield part["vec_id"].to_numpy(dtype=np.int64), _matrix(part["v"].to_list(), width)


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", counts=None) -> DataFrame:
    """Each query's k highest scores: (query_id, rank, vec_id, score), ties to smaller vec_id.

    ``is_query`` is a condition on the column vec_id.  Candidates of a query
    are all rows of another id.  Rows whose id or vector is null, or whose
    vector holds null or non-finite components, take no part; a shorter vector
    counts as filled up with zeros; a repeated query row counts once and
    repeated candidates each.  With fewer than k candidates all are returned.
    Other columns are not read.  ``counts``, two accumulators of whole numbers,
    get the number of scores that were added up in full in phase 2 and of all.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    sound = materialize(vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantize(F.col(vector_col)).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()), "vectors")
    picked = sound.where(is_query).dropDuplicates(["vec_id"])
    n, width = sound.agg(F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-int(n) // QUERY_BLOCK))
    found = []
    for block in range(blocks):
        rows = picked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").collect()  # QUERY_BLOCK in the mean
        if rows:
            ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
            found.append(_search_block(spark, sound, ids, _matrix([r["v"] for r in rows], width), k, counts))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search_block(spark, sound: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, counts=None) -> DataFrame:
    width = queries.shape[1]
    shared = spark.sparkContext.broadcast((ids, queries, _lengths(queries)))

    def merged(top, seen, scores):
        """The k best of two lists of columns, by score and then id."""
        s = scores if top is None else np.concatenate([top[0], scores])
        v = seen if top is None else np.concatenate([top[1], seen])
        order = np.lexsort((v, -s), axis=0)[:k]
        return np.take_along_axis(s, order, 0), np.take_along_axis(v, order, 0)

    def entries(top):
        if top is None:
            return
        s, v = top
        keep = np.isfinite(s)
        q = np.broadcast_to(shared.value[0], s.shape)
        yield pd.DataFrame({"query_id": q[keep], "vec_id": v[keep], "score": s[keep].astype(np.int64)})

    def exact(rows, queries, r, q):
        """Scores of single entries, without a copy of more than 2^16 of them."""
        return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", rows[r[at : at + 65536]], queries[q[at : at + 65536]]) for at in range(0, len(r), 65536)]])

    def local_lists(batches):
        ids, queries, _ = shared.value
        top = None
        for turn, (row_ids, rows) in enumerate(_chunks(batches, width)):
            d = _nodes(width)[turn % BLOCKS]
            kind = _dtype(queries, rows)
            part = (rows[:, d].astype(kind) @ queries[:, d].astype(kind).T).astype(np.float64)
            part[row_ids[:, None] == ids[None, :]] = -np.inf
            pick = _best(part, k)
            q = np.broadcast_to(np.arange(len(ids)), pick.shape)
            score = exact(rows, queries, pick.ravel(), q.ravel()).reshape(pick.shape)
            score[np.isneginf(np.take_along_axis(part, pick, 0))] = -np.inf
            top = merged(top, row_ids[pick], score)
        yield from entries(top)

    listed = sound.mapInPandas(local_lists, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    bound = listed.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_id", "score").collect()  # one row for each query of the block
    floor = np.full(len(ids), -np.inf)
    floor[np.searchsorted(ids, [r["query_id"] for r in bound])] = [r["score"] for r in bound]
    cutoff = spark.sparkContext.broadcast(floor)

    def sufficient(batches):
        ids, queries, query_lengths = shared.value
        floor = cutoff.value
        uniform = np.where(np.isfinite(floor), floor / BLOCKS, -np.inf)
        nodes = _nodes(width)
        top = None
        for row_ids, rows in _chunks(batches, width):
            kind = _dtype(queries, rows)
            lengths = _lengths(rows)
            most = [lengths[n][:, None] * query_lengths[n][None, :] for n in range(BLOCKS)]  # of each part
            total = np.zeros((len(rows), len(ids)))
            reached = np.zeros(total.shape, dtype=bool)
            open_ = row_ids[:, None] != ids[None, :]
            r = q = None
            for n, d in enumerate(nodes):
                if r is None:
                    part = (rows[:, d].astype(kind) @ queries[:, d].astype(kind).T).astype(np.float64)
                    total += part
                    reached |= part >= uniform
                    later = most[n + 1 :]
                    if later:
                        open_ &= (reached | (np.max(later, axis=0) >= uniform)) & (total + np.sum(later, axis=0) >= floor)
                    else:
                        open_ &= reached & (total >= floor)
                    if not later or np.count_nonzero(open_) <= FEW * open_.size:
                        r, q = np.nonzero(open_)
                        score, hit = total[r, q], reached[r, q]
                else:
                    part = exact(rows[:, d], queries[:, d], r, q)
                    score, hit = score + part, hit | (part >= uniform[q])
                    later = [m[r, q] for m in most[n + 1 :]]
                    rest = sum(later) if later else 0
                    keep = (hit | (np.max(later, axis=0) >= uniform[q] if later else False)) & (score + rest >= floor[q])
                    r, q, score, hit = r[keep], q[keep], score[keep], hit[keep]
            if counts is not None:
                counts[0].add(len(r))
                counts[1].add(total.size)
            score = np.rint(score)
            if len(r):
                order = np.lexsort((row_ids[r], -score, q))
                r, q, score = r[order], q[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                r, q, score, place = (x[place < k] for x in (r, q, score, place))
                s = np.full((k, len(ids)), -np.inf)
                v = np.zeros((k, len(ids)), dtype=np.int64)
                s[place, q], v[place, q] = score, row_ids[r]
                top = merged(top, v, s)
        yield from entries(top)

    return sound.mapInPandas(sufficient, "query_id long, vec_id long, score long")


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
