"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_side

#: Edges that a task contracts at a time (16 bytes each), so the most that one task takes.
LOCAL = 1_000_000
#: Edges of a node beyond which its smallest neighbour is broadcast, where such nodes are few, and its edges stay where they are.
HOT = 10_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) of the components of a few edges, without the smallest themselves."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:  # labels only fall; each round follows them to their end
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contract_locally(edges: DataFrame, parts: int) -> DataFrame:
    """edges(a, b) -> fewer edges with the same components: those of each of ``parts`` partitions, LOCAL at a time, as stars."""

    def run(batches):
        held, n = [], 0

        def stars():
            a, b = contract(np.concatenate([x["a"].to_numpy() for x in held]), np.concatenate([x["b"].to_numpy() for x in held]))
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= LOCAL:
                held = [stars()]
                n = len(held[0])
                if n > LOCAL // 2:
                    yield held[0]
                    held, n = [], 0
        if n:
            yield stars()

    return edges.coalesce(parts).mapInPandas(run, "a long, b long")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step on edges (a > b): all neighbours that are larger (or all others) move to the smallest neighbour.

    The smallest neighbour of a node with over HOT edges reaches them as a
    broadcast (there are at most edges / HOT such nodes, and they are counted),
    so no task has to take all edges of one node.
    """
    links = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = materialize(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).withColumn("m", F.least("a", "m")), "least")
    hot = small_side(least.where(F.col("c") > HOT).select("a", F.col("m").alias("hot")))
    tagged = links.join(hot, "a", "left")
    moved = tagged.where("hot IS NULL").join(least.where(F.col("c") <= HOT), "a").select("a", "b", "m").unionByName(tagged.where("hot IS NOT NULL").select("a", "b", F.col("hot").alias("m")))
    if larger:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (node, component), the component being the smallest node that is reachable.

    Nodes without an edge to another node do not appear.  Each round contracts
    the distinct edges within partitions of LOCAL; where one holds them all
    that is the end, else a large-star and a small-star step bring edges of
    different partitions together, until all edges are stars (no node has both
    a smaller and a larger neighbour, or two smaller ones), after a number of
    rounds that grows with the logarithm of the nodes.  Each round's edges are
    written to the shared folder.  Rows with a null end and repeated edges do
    not count; no edges give no rows.
    """
    now = materialize(_distinct(edges), "edges")
    while True:
        parts = max(1, -(-now.count() // LOCAL))
        now, old = materialize(contract_locally(now, parts), "edges"), now
        discard(old)
        if parts == 1:
            break
        heads = now.select(F.col("b").alias("a")).distinct().withColumn("head", F.lit(1))
        ends = now.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y"))
        if ends.join(heads, "a", "left").where("x != y OR head = 1").isEmpty():
            now = now.distinct()
            break
        large = materialize(_star(now, True).distinct(), "edges")
        small = materialize(_star(large, False).distinct(), "edges")
        discard(now, large)
        now = small
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    """Edges once each, the larger end first, made distinct on the map side before they are dealt."""
    sound = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    return sound.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
