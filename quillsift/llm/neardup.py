"""MinHash near-duplicate detection with tensored banding.

A document's set holds its distinct shingles of k words.  Two smaller
collections of M keys each are made from minhashes (R of them to a key); the
M * M table keys are all pairs of one key from either collection.  A pair of
sets with similarity s meets in a table with probability
(1 - (1 - s^R)^M)^2, at the cost of 2 * M * R minhashes instead of the
2 * M * M * R that as many independent tables would take.

1. Equal sets form a class, of which the smallest id goes on.
2. Keys of a collection that only one class has cannot meet; the others are paired to table keys.
3. Every table's members are tied to its smallest member, each tie once.  The
   components of these ties hold all candidate pairs, without any list of pairs.
4. Components are checked in tiles of bounded size on full sets.  A pair is
   passed over only if it is connected already, or if its sizes or the counts
   of its shingles in 256 hash buckets prove it to be below the threshold; all
   others are compared in full, and only the links of a spanning forest leave
   a tile.  A component that is too large for a tile is checked in two rounds:
   first every member with the table head that it shares most tables with, in
   slots of bounded size, which settles a large group of copies in linear
   work; then what is not in the component's largest linked group, with
   itself and with that group, in slots again.
5. Components of the confirmed links, joined back through the classes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, small_side, table, text_hash60, text_slices
from .components import connected_components, contract
from .features import joined, mix64, word_hashes

M = 16
R = 3
HASHES = 2 * M * R
THRESHOLD_PERCENT = 80
#: Weight of a tile's half, and of a document beside its shingles (so a half has at most TILE / ROW documents).
TILE = 500_000
ROW = 256
#: Class members up to which a counted side is broadcast (16 bytes each).
MEMBERS = 500_000
BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20240607)
_MULTIPLIERS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOTS = _rng.integers(0, 2**63, (2 * M, R + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, block by block."""
    data = text.encode("utf-8", "surrogatepass")
    cut = (_LOWER[np.frombuffer(data, dtype=np.uint8, count=min(BLOCK, len(data) - at), offset=at)] for at in range(0, len(data), BLOCK))
    return joined(word_hashes((c, _SPACE[c]) for c in cut))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words as one if there are fewer; none without words."""
    w = words_of(text or "")
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        if len(w) < k:
            return mix64((w * _PLACES[k : k + len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
        h = np.zeros(len(w) - k + 1, dtype=np.uint64)
        for i in range(k):
            h += w[i : len(w) - k + 1 + i] * _PLACES[i]
        return np.unique(mix64(h))


def minhashes(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 1024):
            out = np.minimum(out, ((s[at : at + 1024, None] * _MULTIPLIERS) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


def collection_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, 2 M) keys of the two collections from (rows, HASHES) minhashes."""
    with np.errstate(over="ignore"):
        v = sigs.astype(np.uint64).reshape(len(sigs), 2 * M, R)
        return mix64((v * _SLOTS[None, :, :R]).sum(axis=2, dtype=np.uint64) + _SLOTS[None, :, R])


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, h, sig): set size, digest of the set, minhashes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                out = [(len(s), _digest(s), minhashes(s).tobytes()) for s in (shingle_set(t, k) for t in texts)]
                n, h, sig = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "h", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h binary, sig binary")


def _slot_keys(reps: DataFrame) -> DataFrame:
    """(rep, slot, key): a row for each key of either collection."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at : at + 2048]
                keys = collection_keys(np.frombuffer(b"".join(part["sig"]), dtype=np.uint32).reshape(len(part), HASHES)).view(np.int64)
                yield pd.DataFrame({"rep": np.repeat(part["rep"].to_numpy(), 2 * M), "slot": np.tile(np.arange(2 * M, dtype=np.int32), len(part)), "key": keys.ravel()})

    return reps.select("rep", "sig").mapInPandas(run, "rep long, slot int, key long")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose key two or more of them have."""
    keys = rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("key")
    return rows.join(keys, "key", "left_semi")


def candidate_ties(reps: DataFrame) -> DataFrame:
    """(a, b, c): every member a of a table and the table's smallest member b, once, with the number of their tables."""
    slots = materialize(_shared(_slot_keys(reps)), "slots")
    sides = slots.groupBy("rep").agg(
        F.collect_list(F.when(F.col("slot") < M, F.col("key"))).alias("a"),  # at most M keys each
        F.collect_list(F.when(F.col("slot") >= M, F.col("key"))).alias("b"),
    )
    tables = sides.select("rep", F.explode("a").alias("a"), "b").select("rep", "a", F.explode("b").alias("b")).select("rep", F.xxhash64("a", "b").alias("key"))
    tables = materialize(tables, "tables")
    heads = tables.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("c")).where(F.col("c") > 1).select("key", "head")
    ties = tables.join(heads, "key").where(F.col("rep") != F.col("head")).groupBy(F.col("rep").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("c"))
    out = materialize(ties, "ties")
    discard(slots, tables)
    return out


def _slot(count) -> F.Column:
    return F.pmod(F.xxhash64("rep"), count).cast("int")


def first_tiles(members: DataFrame, large: DataFrame, ties: DataFrame) -> DataFrame:
    """members(rep, h, comp, n, w) -> (rep, h, label, tile, side): small components, and the slots of large ones' heads.

    A component that is not in ``large`` (rep, h, comp, n, w) is one tile.  In
    a large one each member goes with the head it shares most tables with, into
    one of that head's slots; the head is in all of them.
    """
    row = lambda tile: ("rep", "h", F.col("rep").alias("label"), tile.alias("tile"), F.lit(0).alias("side"))
    if large.isEmpty():
        return members.select(*row(F.col("comp").cast("string")))
    comps = small_side(large.select("comp").distinct())
    small = members.join(comps, "comp", "left_anti").select(*row(F.col("comp").cast("string")))
    best = ties.join(large.select(F.col("rep").alias("a"), "h", "w"), "a").groupBy("a", "h", "w").agg(F.max(F.struct("c", (-F.col("b")).alias("b")))["b"].alias("head"))
    best = materialize(best.select(F.col("a").alias("rep"), "h", "w", (-F.col("head")).alias("head")), "best")
    slots = materialize(best.groupBy("head").agg(F.ceil(F.sum("w") / TILE).cast("int").alias("slots")), "slots")
    name = lambda head, slot: F.concat_ws(":", head, slot)
    under = best.join(small_side(slots), "head").select(*row(name(F.col("head"), _slot(F.col("slots")))))
    every = slots.join(large.select(F.col("rep").alias("head"), "h"), "head").select(F.col("head").alias("rep"), "h", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    return small.unionByName(under).unionByName(every.select(*row(name(F.col("rep"), F.col("slot")))))


def second_tiles(large: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs of large components that the first tiles left open, as (rep, h, label, tile, side).

    ``links`` are those of the first tiles.  Of each component the linked group
    with most weight is the core; all others are the rest.  Both are cut by set
    size (sizes of linked sets are at most one class apart) and by hash into
    slots of about TILE; every two slots of equal or neighbouring size classes
    are a tile with two sides, but for two slots of the core.
    """
    labels = connected_components(links.select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    found = materialize(large.join(small_side(labels, MEMBERS), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labels")
    groups = found.groupBy("comp", "label").agg(F.sum("w").alias("w"))
    core = groups.groupBy("comp").agg(F.max(F.struct("w", "label"))["label"].alias("core"), F.count("*").alias("groups")).where("groups > 1").select("comp", "core")
    cut = F.floor(F.log("n") / math.log(100 / THRESHOLD_PERCENT + 0.01)).cast("int")
    rows = materialize(found.join(small_side(core), "comp").select("rep", "h", "label", "comp", "w", (F.col("label") == F.col("core")).alias("core"), cut.alias("c")), "open")
    slots = materialize(rows.groupBy("comp", "core", "c").agg(F.ceil(F.sum("w") / TILE).cast("int").alias("slots")), "slots")
    placed = rows.join(small_side(slots), ["comp", "core", "c"]).withColumn("s", _slot(F.col("slots"))).drop("slots")
    other = small_side(slots.select("comp", F.col("core").alias("core2"), F.col("c").alias("c2"), "slots"))
    met = placed.join(other, "comp").where("abs(c - c2) <= 1 AND NOT (core AND core2)").withColumn("s2", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    here, there = F.concat_ws("/", "core", "c", "s"), F.concat_ws("/", "core2", "c2", "s2")
    return met.select("rep", "h", "label", F.concat_ws(":", "comp", F.least(here, there), F.greatest(here, there)).alias("tile"), F.when(here == there, 0).when(here < there, 1).otherwise(2).alias("side"))


def spanning_links(ids, sides, labels, sets: list[np.ndarray], percent: int = THRESHOLD_PERCENT) -> list[tuple[int, int]]:
    """Confirmed links that connect what the pairs of a tile connect; equal labels are connected already.

    All pairs are looked at (with two sides: those across), those with most
    neighbours first, so that most other pairs are connected by the time they
    come up.  |A and B| is at most the sum of the smaller counts over hash
    buckets, which rules out most unlike pairs without a look at their sets.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    sides = np.asarray(sides)
    counts = np.stack([np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) for s in sets]).astype(np.int32)
    names, root = np.unique(np.asarray(labels), return_inverse=True)
    left = len(names)
    at_most = lambda i, js: np.minimum(counts[js], counts[i]).sum(axis=1, dtype=np.int32)
    some = np.arange(0, n, max(1, n // 64))
    central = np.array([at_most(i, some).sum() / max(1, size[i]) for i in range(n)])
    todo = np.ones(n, dtype=bool)
    links = []
    for i in np.argsort(-central, kind="stable").tolist():
        if left == 1:
            break
        todo[i] = False
        js = np.flatnonzero(todo & (root != root[i]) & ((sides != sides[i]) if sides[i] else True))
        js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
        if not len(js):
            continue
        most = np.concatenate([at_most(i, js[at : at + 1024]) for at in range(0, len(js), 1024)]).astype(np.int64)
        ok = 100 * most >= percent * (size[js] + size[i] - most)
        js = js[ok][np.argsort(-most[ok], kind="stable")].tolist()
        for at in range(0, len(js), 32):
            open_js = [j for j in js[at : at + 32] if root[j] != root[i]]
            if not open_js:
                continue
            for j, common in zip(open_js, common_counts(sets[i], [sets[j] for j in open_js])):
                if 100 * common >= percent * (size[i] + size[j] - common) and root[j] != root[i]:
                    links.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
                    left -= 1
    return links


def common_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the other sorted sets has in common with one; no set is empty."""
    every = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, every), len(one) - 1)
    return np.add.reduceat((one[place] == every).astype(np.int64), np.cumsum([0] + [len(o) for o in others[:-1]]))


def confirmed_links(docs: DataFrame, dealt: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text), dealt(rep, h, label, tile, side) -> (a, b, alone), checked on full sets.

    ``alone`` marks the links of a tile that holds a whole component: they are stars to the smallest id already.
    """
    dealt = materialize(dealt, "tiles")
    wanted = small_side(dealt.select(F.col("rep").alias("doc_id"), F.col("h").alias("want")).distinct(), MEMBERS)

    def full(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                rows = [(i, w, s.tobytes()) for i, w, s in zip(part.column("doc_id").to_pylist(), part.column("want").to_pylist(), (shingle_set(t, k) for t in texts)) if _digest(s) == w]
                if rows:
                    rep, h, grams = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(h, pa.binary()), pa.array(grams, pa.binary())], names=["rep", "h", "grams"])

    grams = docs.join(wanted, "doc_id").select("doc_id", "text", "want").mapInArrow(full, "rep long, h binary, grams binary")
    placed = grams.join(small_side(dealt, MEMBERS), ["rep", "h"]).repartition("tile").sortWithinPartitions("tile", "rep")

    def check(batches):
        tile, held = None, []

        def close():
            if len(held) > 1:
                ids, sides, labels, raw = zip(*held)
                found = spanning_links(ids, sides, labels, [np.frombuffer(g, dtype=np.uint64) for g in raw])
                if found:
                    a, b = np.array(found, dtype=np.int64).T
                    yield pd.DataFrame(dict(zip("ab", contract(a, b))) | {"alone": ":" not in tile})

        for batch in batches:
            for t, *row in zip(*[batch[c] for c in ("tile", "rep", "side", "label", "grams")]):
                if t != tile:
                    yield from close()
                    tile, held = t, []
                held.append(row)
        yield from close()

    return placed.select("tile", "rep", "side", "label", "grams").mapInPandas(check, "a long, b long, alone boolean")


def near_duplicates(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Documents are linked where 100 * |A and B| >= 80 * |A or B| over their sets
    of k-word shingles; component_id is the smallest id that is reachable by
    links, itself included, and ``kept`` marks the rows whose id that is.
    Words are runs without ASCII white space, A-Z lower-cased.  Texts without
    words (null, empty) have empty sets and are linked with nothing; shorter
    texts than k words have one shingle, all of it.  Rows of a null id are
    kept, with null component_id.  Repeated rows are equal documents; one id
    with several texts counts as linked to itself.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = given.where(F.col("doc_id").isNotNull())
    sk = materialize(sketches(known, k), "sketches")
    classes = sk.where(F.col("n") > 0).groupBy("h").agg(F.min(F.struct("doc_id", "n", "sig")).alias("x"), F.count("*").alias("c"))
    reps = materialize(classes.select(F.col("x.doc_id").alias("rep"), "h", F.col("x.n").alias("n"), F.col("x.sig").alias("sig"), "c"), "reps")
    ties = candidate_ties(reps)
    comps = connected_components(ties)
    members = materialize(reps.select("rep", "h", "n", (F.col("n") + ROW).alias("w")).join(small_side(comps.select(F.col("node").alias("rep"), F.col("component").alias("comp")), MEMBERS), "rep"), "members")
    heavy = members.groupBy("comp").agg(F.sum("w").alias("total")).where(F.col("total") > 2 * TILE).select("comp")
    large = materialize(members.join(small_side(heavy), "comp"), "large")
    links = materialize(confirmed_links(known, first_tiles(members, large, ties), k), "links")
    stars = links.where("alone").select("a", "b")
    links = links.where("NOT alone").select("a", "b")
    if not large.isEmpty():
        links = links.unionByName(materialize(confirmed_links(known, second_tiles(large, links), k), "links").select("a", "b"))
    linked = connected_components(links).unionByName(stars.select(F.col("a").alias("node"), F.col("b").alias("component")))
    discard(ties, members, large)
    several = small_side(reps.where("c > 1").select("h", "rep"), MEMBERS)
    reach = small_side(linked.select(F.col("node").alias("rep"), "component"), MEMBERS)
    out = (
        sk.select("doc_id", "n", "h")
        .join(several, "h", "left")
        .withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
        .join(reach, "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
    )
    unknown = given.where(F.col("doc_id").isNull()).mapInPandas(lambda it: _sizes(it, k), "doc_id long, n_shingles long, component_id long")
    return out.unionByName(unknown).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """documents without all but one of each group of near duplicates (the smallest id stays; within it the text of the smallest hash).

    Rows of one id are documents of their own where their texts differ, so an
    unlike text stays; of rows with equal id and text (null: empty) one stays.  Rows of a
    null id stay.  Only ids that go, or come more than once, are joined, and
    texts move only where those are too many to broadcast.
    """
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    ids = materialize(ids, "repeated")
    if ids.isEmpty():
        gone = materialize(near_duplicates(docs, k).where("NOT kept").select("doc_id"), "removed")
        return docs.join(small_side(gone, MEMBERS), "doc_id", "left_anti").select(*docs.columns)
    # Each text of a repeated id gets a number of its own below all ids (60 bits of a hash); equal ones share it.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    again = small_side(ids.select("doc_id", F.lit(True).alias("again")), MEMBERS)
    own = packed.join(again, "doc_id", "left").withColumn("own", F.when(F.col("again"), -1 - text_hash60(F.col("doc_id"), F.col("text"))).otherwise(F.col("doc_id")))
    numbered = materialize(own.select("own", "doc_id", "row", "text", F.coalesce("again", F.lit(False)).alias("again")), "numbered")
    found = materialize(near_duplicates(numbered, k, "own").where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("own"), "component_id").distinct(), "grouped")
    # The numbers' order is not that of the ids, so each group of several members is asked for its first row by (doc_id, own).
    groups = small_side(found.where("own <> component_id").select("component_id").distinct(), MEMBERS)
    members = found.join(groups, "component_id", "left_semi").join(numbered.select("own", F.col("doc_id").alias("id")).distinct(), "own")
    first = members.groupBy("component_id").agg(F.min(F.struct("id", "own")).alias("first"))
    gone = materialize(members.join(first, "component_id").where(F.col("own") != F.col("first.own")).select("own"), "removed")
    stay = numbered.join(small_side(gone, MEMBERS), "own", "left_anti")
    return stay.where("NOT again").select("row.*").unionByName(stay.where("again").dropDuplicates(["own"]).select("row.*"))


def _sizes(batches, k):
    for b in batches:
        yield pd.DataFrame({"doc_id": [None] * len(b), "n_shingles": [len(shingle_set(t, k)) for t in b["text"]], "component_id": [None] * len(b)}).astype({"doc_id": "Int64", "component_id": "Int64"})


def op9_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT n.doc_id, n.n AS n_shingles, min(reach)::BIGINT AS component_id, n.doc_id = min(reach) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
