"""Vector code compression: product codes learned by Lloyd's steps in whole numbers.

A vector's components become integers, and the vector is cut into parts of
equal width; each place of a part has a codebook of its own.  Equal parts of a
place are one weighted row, so the steps go over distinct values however often
each comes.  Sums and distances are 64-bit integers, so the result does not
depend on how rows are dealt, and a task that runs again gives the same.

A step is a job over the distinct rows: a task adds up what its rows give to
each entry (parts x entries rows, whatever it reads), and the totals, one row
for each component of the codebooks, come to the driver, which holds nothing
else.  Codes and errors are joined back to the vectors part by part.  Values
that more than one in HOT parts of a place has, of which there are less than
HOT a place, are joined by a broadcast, so no key of the shuffle has more.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side, table

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
HOT = 1000


def quantize(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long integers; null if the vector, or any component, is null or not finite."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(as_double, lambda x: F.floor(x * F.lit(float(scale)))))


@dataclass
class Codebooks:
    """``entries``: an array of parts x entries x width integers; ``most``: the bound to which components are clamped."""

    entries: np.ndarray
    most: int
    scale: int = SCALE

    def digest(self) -> str:
        """Hex SHA-256 of all integers, by part, entry and place in the part, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: Column) -> Column:
        """The vector that an array of codes stands for: the middle of each integer's interval."""
        held = F.lit(((self.entries + 0.5) / self.scale).tolist()) if self.entries.size else F.array().cast("array<array<array<double>>>")
        return F.flatten(F.zip_with(held, codes, lambda book, code: book[code]))


def nearest(x: np.ndarray, book: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, ties to the lower index."""
    if most > 1 << 22:  # sums of products could leave the whole numbers of doubles
        far = np.stack([((x - e) ** 2).sum(axis=1) for e in book], axis=1)
        at = far.argmin(axis=1)
        return at, far[np.arange(len(x)), at]
    far = (book.astype(np.float64) ** 2).sum(axis=1) - 2.0 * (x.astype(np.float64) @ book.T.astype(np.float64))
    at = far.argmin(axis=1)
    return at, ((x - book[at]) ** 2).sum(axis=1)


def _by_place(batch, width: int):
    """(place, rows of the batch, their parts as a matrix) for each place in an Arrow batch."""
    places = batch.column("place").to_numpy(zero_copy_only=False)
    values = batch.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(places), width)
    for place in np.unique(places):
        rows = np.flatnonzero(places == place)
        yield int(place), rows, values[rows]


def prepare(vectors: DataFrame, id_col: str, vector_col: str, carry: list[str], parts: int, scale: int) -> tuple[DataFrame, int, int]:
    """(rows(uid, id, carried columns, v), width of a part, bound of the components), the rows written to the shared folder.

    Vectors that are shorter than the longest one, or than the next multiple of
    ``parts``, are filled up with zeros.  Components are clamped to a bound that
    keeps squared distances within 64 bits: 2^27 for 64 components, so that it
    is beyond |x| = 32768.
    """
    given = vectors.select(F.col(id_col).alias("id"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry], quantize(F.col(vector_col), scale).alias("v")).where("v IS NOT NULL")
    longest = given.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    most = isqrt((1 << 62) // (width * parts)) // 2
    clamped = F.transform("v", lambda x: F.greatest(F.least(x, F.lit(most)), F.lit(-most)).cast("int"))
    full = F.concat(clamped, F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("v")))
    return materialize(given.withColumn("v", full).withColumn("uid", F.monotonically_increasing_id()), "vectors"), width, most


def _cut(rows: DataFrame, parts: int, width: int, *keys: str) -> DataFrame:
    pieces = F.array(*[F.slice("v", p * width + 1, width) for p in range(parts)])
    return rows.select(*keys, F.posexplode(pieces).alias("place", "part"))


def distinct_parts(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """(place, part, weight), written to the shared folder: equal parts meet as counts on the map side."""
    return materialize(_cut(rows, parts, width).groupBy("place", "part").agg(F.count("*").alias("weight")), "parts")


def fit(rows: DataFrame, distinct: DataFrame, parts: int, width: int, most: int, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks from the parts of the ``entries`` smallest ids (null ids last, ties by vector) and weighted Lloyd's steps; unused entries stay."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    book = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    if not len(first):
        return Codebooks(book, most, scale)
    for _ in range(rounds):
        now = book.copy()

        def add(batches, now=now):
            import pyarrow as pa

            total, count = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                weights = batch.column("weight").to_numpy(zero_copy_only=False)
                for place, at, x in _by_place(batch, now.shape[2]):
                    code, _ = nearest(x, now[place], most)
                    np.add.at(count[place], code, weights[at])
                    np.add.at(total[place], code, x * weights[at][:, None])
            place, entry = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({"place": place.astype(np.int32), "entry": entry.astype(np.int32), "n": count[place, entry], "total": pa.array(list(total[place, entry]), pa.list_(pa.int64()))})

        partial = distinct.mapInArrow(add, "place int, entry int, n long, total array<long>")
        sums = partial.groupBy("place", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
        for r in sums.collect():  # a row for each entry
            book[r["place"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return Codebooks(book, most, scale)


def assign(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """(place, part, weight, code, error), written to the shared folder."""
    book, most = books.entries, books.most

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for place, at, x in _by_place(batch, book.shape[2]):
                code[at], error[at] = nearest(x, book[place], most)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("place", "part", "weight")], pa.array(code), pa.array(error)], names=["place", "part", "weight", "code", "error"])

    return materialize(distinct.mapInArrow(run, "place int, part array<int>, weight long, code int, error long"), "coded-parts")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """((id, carried columns as c_<name>, codes, error), codebooks) of all rows with a sound vector.

    Rows whose vector is null, or holds a null or a component that is not
    finite, take no part; repeated rows each give a row; fewer rows than
    ``entries`` give smaller codebooks; an empty table gives an empty result.
    Lengths and huge components: see ``prepare``.
    """
    rows, width, most = prepare(vectors, id_col, vector_col, list(carry), parts, scale)
    distinct = distinct_parts(rows, parts, width)
    books = fit(rows, distinct, parts, width, most, entries, rounds, scale)
    if not books.entries.size:
        nothing = rows.where(F.lit(False)).select("id", *[f"c_{c}" for c in carry], F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return nothing, books
    coded = assign(distinct, books).withColumn("x", F.struct("code", "error"))
    bar = F.col("weight") * HOT > rows.count()
    hot = coded.where(bar).select("place", "part", F.col("x").alias("hot"))  # less than HOT of each place
    cut = _cut(rows, parts, width, "uid").join(F.broadcast(hot), ["place", "part"], "left")
    seldom = cut.where("hot IS NULL").join(coded.where(~bar).select("place", "part", "x"), ["place", "part"]).select("uid", "place", "x")
    both = seldom.unionByName(cut.where("hot IS NOT NULL").select("uid", "place", F.col("hot").alias("x")))
    ordered = F.sort_array(F.collect_list(F.struct("place", "x")))  # as many as there are parts
    whole = both.groupBy("uid").agg(F.transform(ordered, lambda p: p["x"]["code"]).alias("codes"), F.sum("x.error").alias("error"))
    return rows.drop("v").join(whole, "uid").drop("uid"), books


def hex_codes(codes: Column) -> Column:
    """Two lower-case hex digits for each code."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"), carry=("label",))
    found = materialize(found.select(F.col("id").alias("vec_id"), F.col("c_label").alias("label"), hex_codes(F.col("codes")).alias("code"), "error"), "codes")
    per_label = small_side(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"))
    return found.join(per_label, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    far = "list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    steps = ""
    for r in range(ROUNDS + 1):
        steps += f""",
a{r} AS MATERIALIZED (SELECT p.row_no, p.place, min({{'d': {far}::BIGINT, 'e': c.e}}) AS m FROM p JOIN c{r} c USING (place) GROUP BY p.row_no, p.place)"""
        if r < ROUNDS:
            steps += f""",
s{r} AS (SELECT place, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT p.place, m.e AS e, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS i FROM p JOIN a{r} USING (row_no, place)) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.place, c.e, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT place, e, list(x ORDER BY i) AS v FROM s{r} GROUP BY place, e) n USING (place, e))"""
    return f"""
WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row_no, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row_no, place, v[place * (len(v) // {PARTS}) + 1:(place + 1) * (len(v) // {PARTS})] AS v FROM k, (SELECT unnest(range(0, {PARTS})) AS place)),
c0 AS MATERIALIZED (SELECT place, (row_no - 1)::INT AS e, v FROM p WHERE row_no <= {ENTRIES}){steps},
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY place, e)) AS h FROM c{ROUNDS}),
e AS (SELECT row_no, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY place) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY row_no)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN e USING (row_no), b
"""


OP13_SQL = _sql()
