"""Topics by spherical K-Means, several starts at once.

Units are sparse vectors of hashed terms, weighted by TF-IDF and of unit length,
held as whole numbers so that sums do not depend on how rows are dealt.  All
starts go through the same jobs: a step scores a unit against the centres of
every start by one sparse product and adds up what each centre gets.  Starts are
seeded by oversampling in rounds: a unit is drawn with a chance in proportion to
its distance from the start's seeds so far, the seeds are weighted by the units
nearest to them, and a greedy choice of ``k`` among these few ends the seeding.
The start whose units lie nearest to their centres is kept.

Centres and seeds are what the driver and the tasks hold: starts x k x features
numbers, and about starts x rounds x 2k drawn units.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .text import let
from .topics import STOP_WORDS, TERM

FEATURES = 4096
STARTS, ROUNDS, STEPS = 10, 3, 20
#: Whole numbers in a weight of one.
UNIT = 1 << 20
SEED = 42
#: Products that are held at a time.
CELLS = 1 << 22


def unit_vectors(units: DataFrame, key: str, text_col: str = "text", features: int = FEATURES) -> DataFrame:
    """(key, at: array<int>, x: array<int>): the places and weights of a unit's hashed terms; a unit without terms has none."""
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(TERM), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))
    placed = units.select(key, F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int")).alias("p"))
    counted = materialize(placed.select(key, F.explode_outer("p").alias("p")).groupBy(key, "p").agg(F.count("p").alias("n")), "hashed-terms")
    total = units.count()
    idf = counted.where("p IS NOT NULL").groupBy("p").agg((F.log((1 + F.lit(total)) / (1 + F.count("*"))) + 1).alias("idf"))  # a row for each feature at most
    raw = counted.join(F.broadcast(idf), "p", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", (F.col("n") * F.col("idf")).alias("w"))))).alias("ws"))
    length = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    x = let(length, lambda n: F.transform("ws", lambda x: F.round(F.lit(UNIT) * x["w"] / n).cast("int")))
    return raw.select(key, F.transform("ws", lambda x: x["p"]).alias("at"), x.alias("x"))


def _dense(at, x, features: int) -> np.ndarray:
    out = np.zeros(features)
    out[list(at)] = x
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def _batches(batch):
    """(row numbers, places, weights) of all numbers of an Arrow batch of sparse vectors."""
    sizes = np.array([n or 0 for n in batch.column("at").value_lengths().to_pylist()], np.int64)
    at, x = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "x"))
    return np.repeat(np.arange(len(sizes)), sizes), at, x


def _blocks(batch, features: int):
    """(first row, a matrix of the next rows), for matrix products; of CELLS numbers at most."""
    rows, at, x = _batches(batch)
    step = max(1, CELLS // features)
    for first in range(0, batch.num_rows, step):
        a, b = np.searchsorted(rows, [first, first + step])
        block = np.zeros((min(step, batch.num_rows - first), features))
        block[rows[a:b] - first, at[a:b]] = x[a:b]
        yield first, block


def similarities(batch, centres: np.ndarray) -> np.ndarray:
    """Rows of the batch x centres: cosines; ``centres`` are of unit length."""
    out = np.zeros((batch.num_rows, len(centres)))
    for first, block in _blocks(batch, centres.shape[1]):
        out[first : first + len(block)] = block @ centres.T
    return out / UNIT


@dataclass
class Topics:
    """``centres``: k rows of unit length; ``costs``: what each start came to; ``best``: the start that was kept."""

    centres: np.ndarray
    costs: list[float]
    best: int


def _drawn(units: DataFrame, seeds: list[np.ndarray], wanted: int, turn: int, key: str) -> list[list[np.ndarray]]:
    """For each start the units that its round draws; a hash of key, start and round decides."""
    starts, width = len(seeds), seeds[0].shape[1]
    held = np.concatenate(seeds)
    ends = np.cumsum([len(s) for s in seeds])[:-1]

    def cost(batches):
        import pyarrow as pa

        total = np.zeros(starts, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += _far(batch).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"start": pa.array(range(starts), pa.int32()), "cost": pa.array(total, pa.int64())})

    def _far(batch):
        near = np.stack([part.max(axis=1) for part in np.split(similarities(batch, held), ends, axis=1)], axis=1)
        return np.round(UNIT * np.clip(1 - near, 0, 2)).astype(np.int64)

    costs = {r["start"]: r["cost"] for r in units.mapInArrow(cost, "start int, cost long").groupBy("start").agg(F.sum("cost").alias("cost")).collect()}
    chance = np.array([wanted / costs[s] if costs.get(s) else 0.0 for s in range(starts)])

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            lots = batch.column("lots").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, starts)
            rows, which = np.nonzero(lots < _far(batch) * chance) if batch.num_rows else (np.zeros(0, int),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), batch.column("at").take(pa.array(rows)), batch.column("x").take(pa.array(rows))], names=["start", "at", "x"])

    lots = F.array(*[(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(f"{turn}:{s}:{SEED}")), F.lit(1 << 30)) / float(1 << 30)) for s in range(starts)])
    found = units.withColumn("lots", lots).select("lots", "at", "x").mapInArrow(draw, "start int, at array<int>, x array<int>").collect()
    out: list[list] = [[] for _ in range(starts)]
    for r in sorted(found, key=lambda r: (r["start"], r["at"], r["x"])):
        out[r["start"]].append(_dense(r["at"], r["x"], width))
    return out


def seed(units: DataFrame, k: int, key: str, starts: int = STARTS, rounds: int = ROUNDS, features: int = FEATURES) -> np.ndarray:
    """starts x k x features: the first centres.  Fewer distinct units than k leave centres of zeros, which no unit takes."""
    first = units.where(F.size("at") > 0)
    order = [F.xxhash64(F.col(key).cast("string"), F.lit(f"first:{s}:{SEED}")) for s in range(starts)]
    ones = first.agg(*[F.min(F.struct(o.alias("o"), "at", "x")).alias(f"s{s}") for s, o in enumerate(order)]).first()
    if ones["s0"] is None:
        return np.zeros((starts, k, features))
    seeds = [_unit(_dense(ones[f"s{s}"]["at"], ones[f"s{s}"]["x"], features)[None]) for s in range(starts)]
    for turn in range(rounds):
        for s, more in enumerate(_drawn(first, seeds, 2 * k, turn, key)):
            if more:
                seeds[s] = np.unique(np.concatenate([seeds[s], _unit(np.array(more))]).round(12), axis=0)
    weights = _sums(first, seeds, sums=False)[1]
    return np.stack([_chosen(s, w, k) for s, w in zip(seeds, weights)])


def _chosen(seeds: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """``k`` of a start's seeds: the heaviest, then whatever has the largest weight times distance."""
    out = np.zeros((k, seeds.shape[1]))
    far = np.ones(len(seeds))
    for i in range(min(k, len(seeds))):
        at = int(np.argmax(weights * far))
        out[i] = seeds[at]
        far = np.minimum(far, np.clip(1 - seeds @ seeds[at], 0, 2).round(9))
        if not (weights * far).any():
            break
    return out


def _sums(units: DataFrame, centres: list[np.ndarray], sums: bool = True) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """For each start: what its centres' units sum up to (zeros without ``sums``), how many they are, and the cost; one job over all units."""
    held = np.concatenate(centres)
    live = np.linalg.norm(held, axis=1) > 0
    ends = np.cumsum([len(c) for c in centres])
    begins = np.concatenate([[0], ends[:-1]])

    def add(batches):
        import pyarrow as pa

        total, count, cost = np.zeros(held.shape, np.int64), np.zeros(len(held), np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for _, block in _blocks(batch, held.shape[1]):
                near = np.where(live, (block @ held.T / UNIT).round(9), -np.inf)
                takes = np.zeros(near.shape)
                for s, (a, b) in enumerate(zip(begins, ends)):
                    mine = near[:, a:b].argmax(axis=1) + a
                    takes[np.arange(len(mine)), mine] = 1
                    cost[s] += np.round(UNIT * (1 - near[np.arange(len(mine)), mine])).astype(np.int64).sum()
                if sums:
                    total += (takes.T @ block).astype(np.int64)  # whole numbers far below 2^53, so exact
                count += takes.sum(axis=0).astype(np.int64)
        found = [(c, int(count[c]), total[c].tobytes()) for c in np.flatnonzero(count).tolist()] + [(-1, 0, cost.tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*found), (pa.int32(), pa.int64(), pa.binary()))], names=["c", "n", "x"])

    def merge(key, part):
        return pd.DataFrame([(key[0], part["n"].sum(), sum(np.frombuffer(x, np.int64) for x in part["x"]).tobytes())], columns=["c", "n", "x"])

    total, count, cost = np.zeros(held.shape), np.zeros(len(held)), np.zeros(len(centres))
    # A row for each centre from each task.
    for r in units.select("at", "x").mapInArrow(add, "c int, n long, x binary").groupBy("c").applyInPandas(merge, "c int, n long, x binary").collect():
        if r["c"] < 0:
            cost = np.frombuffer(r["x"], np.int64) / UNIT
        else:
            total[r["c"]], count[r["c"]] = np.frombuffer(r["x"], np.int64), r["n"]
    return [total[a:b] for a, b in zip(begins, ends)], [count[a:b] for a, b in zip(begins, ends)], cost.tolist()


def fit(units: DataFrame, k: int, key: str, starts: int = STARTS, steps: int = STEPS, features: int = FEATURES, first: np.ndarray | None = None) -> Topics:
    """units(key, at, x) -> topics; ``first`` may give the first centres of every start.  Ends when no centre of any start moves."""
    centres = seed(units, k, key, starts, features=features) if first is None else first
    known = units.where(F.size("at") > 0)
    costs = [0.0] * len(centres)
    for _ in range(steps):
        total, count, costs = _sums(known, list(centres))
        moved = np.stack([np.where(n[:, None] > 0, _unit(t), old) for t, n, old in zip(total, count, centres)])
        if np.array_equal(moved, centres):
            break
        centres = moved
    else:
        costs = _sums(known, list(centres))[2]
    best = int(np.argmin(np.round(costs, 6)))
    return Topics(centres[best], costs, best)


def assign(units: DataFrame, topics: Topics, key: str) -> DataFrame:
    """(key, topic, similarity): the nearest centre, ties to the lower number; a unit without terms is of topic 0 with similarity 0."""
    centres = topics.centres
    live = np.linalg.norm(centres, axis=1) > 0

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows and live.any():
                near = np.where(live, similarities(batch, centres).round(9), -np.inf)
                at = near.argmax(axis=1)
                best = near[np.arange(len(at)), at]
            else:
                at, best = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(at, pa.int32()), pa.array(best, pa.float64())], names=[key, "topic", "similarity"])

    return units.select(key, "at", "x").mapInArrow(run, f"`{key}` {units.schema[key].dataType.simpleString()}, topic int, similarity double")


def topic_model(docs: DataFrame, key: str, k: int, text_col: str = "text", starts: int = STARTS) -> tuple[DataFrame, Topics]:
    """((key, topic, similarity), topics) of texts."""
    units = materialize(unit_vectors(docs, key, text_col), "unit-vectors")
    found = fit(units, k, key, starts)
    return assign(units, found, key), found
