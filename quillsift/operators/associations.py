"""Associated keywords: terms that keep the company a keyword keeps.

Counts of terms that stand within a few words of one another make a symmetric
matrix; its entries become positive pointwise mutual information, and terms are
compared by the cosine of their rows.  A question's terms read their own rows as
contexts (the matrix is symmetric, so a row is a column), and those meet the
lists of the contexts they hold: a question against all rows, never all pairs of
terms.

``associates_of`` answers one question from the sentences: entries are counted
in Arrow batches, meet once, and are added up as they come, so the matrix is
nowhere written.  ``build`` stores it by context for many questions.

Every context counts, however frequent.  ``most_terms`` leaves out contexts
that stand beside more terms than that, for a faster approximate answer; without
it (the default) the cosines are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.index import CODEC
from ..sources.shared import BROADCAST_ROWS, exists, materialize, small_side
from .text import token_array

WINDOW = 5
#: Associates of a keyword, and neighbours that a term must have to be one.
ASSOCIATES, LEAST = 4, 10


def neighbours(tokens: Column, window: int = WINDOW) -> Column:
    """Pairs (a, b), a <= b, of the tokens of an array at most ``window`` places apart, each once."""

    def apart(d: int) -> Column:
        n = F.greatest(F.size(tokens) - d, F.lit(0))
        return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(d + 1), n), lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))

    return F.concat(*[apart(d) for d in range(1, window + 1)])


def cooccurrences(sents: DataFrame, window: int = WINDOW, text_col: str = "sentence") -> DataFrame:
    """(term, ctx, n), symmetric: pairs are counted once, on the map side first, and mirrored as counts."""
    tokens = sents.select(token_array(F.col(text_col)).alias("t")).where(F.size("t") > 1)
    pairs = tokens.select(F.explode(neighbours(F.col("t"), window)).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("ctx"), (2 * F.col("n")).alias("n"))))
    sides = both.otherwise(F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("ctx"), "n"), F.struct(F.col("b").alias("term"), F.col("a").alias("ctx"), "n")))
    return pairs.select(F.explode(sides).alias("x")).select("x.*")


def neighbour_totals(sents: DataFrame, window: int = WINDOW, text_col: str = "sentence") -> DataFrame:
    """(term, n): the sum of a term's row of counts, from its places alone."""
    tokens = sents.select(token_array(F.col(text_col)).alias("t")).where(F.size("t") > 1)
    beside = lambda x, i: F.struct(x.alias("term"), (F.least(i, F.lit(window)) + F.least(F.size("t") - 1 - i, F.lit(window))).alias("n"))
    return tokens.select(F.explode(F.transform("t", beside)).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n"))


def build(sents: DataFrame, path: str, window: int = WINDOW, text_col: str = "sentence") -> dict[str, DataFrame]:
    """sents(sentence) -> tables under ``path``.

    * weights(ctx, term, w), the positive entries, by range of ctx and term;
    * terms(term, n, length): neighbours of a term and the length of its row.
    """
    spark = sents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    totals = materialize(neighbour_totals(sents, window, text_col), "term-totals")
    whole = totals.agg(F.sum("n")).first()[0] or 0
    side = small_side(totals)
    of = lambda name: side.select(F.col("term").alias(name), F.col("n").alias(f"n_{name}"))
    lift = F.col("n").cast("double") * F.lit(float(whole)) / (F.col("n_term").cast("double") * F.col("n_ctx"))
    counts = cooccurrences(sents, window, text_col)
    weights = counts.join(of("term"), "term").join(of("ctx"), "ctx").select("ctx", "term", F.log(lift).alias("w")).where("w > 0")
    # Dealing by range samples the result of the shuffle that counts pairs; the pairs are not made again.
    weights.repartitionByRange(parts, "ctx", "term").sortWithinPartitions("ctx", "term").write.option("compression", CODEC).mode("overwrite").parquet(f"{path}/weights")
    stored = spark.read.parquet(f"{path}/weights")
    lengths = stored.groupBy("term").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    totals.join(lengths, "term", "left").fillna(0.0, ["length"]).write.mode("overwrite").parquet(f"{path}/terms")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of associations; raises FileNotFoundError where one was not written to its end."""
    for name in ("weights", "terms"):
        if not exists(spark, f"{path}/{name}/_SUCCESS"):
            raise FileNotFoundError(f"no table {name} under {path}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("weights", "terms")}


def associates(tables: dict[str, DataFrame], keywords: list[str], n: int = ASSOCIATES, least: int = LEAST, most_terms: int | None = None) -> DataFrame:
    """(term, rank, associate, cosine): the ``n`` terms most like each keyword, ties by term.

    Keywords are no associates, nor are terms with fewer than ``least``
    neighbours.  A keyword that the corpus does not have gives no row.
    """
    weights, terms = tables["weights"], tables["terms"]
    asked = weights.where(F.col("ctx").isin(*keywords)).select(F.col("ctx").alias("q"), F.col("term").alias("ctx"), F.col("w").alias("qw"))
    if most_terms is not None:
        widths = weights.groupBy("ctx").agg(F.count("*").alias("width")).where(F.col("width") <= most_terms)
        asked = asked.join(widths.select("ctx"), "ctx", "left_semi")
    asked = materialize(asked, "asked")
    dots = weights.join(small_side(asked), "ctx").where(~F.col("term").isin(*keywords)).groupBy("q", "term").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    known = small_side(terms.where(F.col("n") >= least).select("term", "length"))
    own = F.broadcast(terms.where(F.col("term").isin(*keywords)).select(F.col("term").alias("q"), F.col("length").alias("q_length")))  # a row for each keyword
    scored = dots.join(known, "term").join(own, "q").select("q", "term", F.round(F.col("dot") / (F.col("length") * F.col("q_length")), 6).alias("cosine"))
    return _best(scored, n)


#: Tokens that are counted at a time.
TOKENS = 2_000_000


def _counted(sents: DataFrame, text_col: str, window: int, counts, schema: str) -> DataFrame:
    """``counts(terms, a, b)`` of about TOKENS tokens at a time: the distinct terms and the pairs of their numbers, ``window`` places apart at most."""
    given = sents.select(token_array(F.col(text_col)).alias("t")).where(F.size("t") > 1)
    most = TOKENS

    def run(batches):
        import pyarrow as pa

        def made(held):
            coded = pa.chunked_array([x.flatten() for x in held]).combine_chunks().dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in held])
            of = np.repeat(np.arange(len(sizes)), sizes)
            together = [of[d:] == of[:-d] for d in range(1, window + 1)]
            a = np.concatenate([codes[:-d][t] for d, t in enumerate(together, 1)])
            b = np.concatenate([codes[d:][t] for d, t in enumerate(together, 1)])
            return counts(coded.dictionary, a, b)

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.column("t"))
            n += len(held[-1].flatten())
            if n >= most:
                yield made(held)
                held, n = [], 0
        if held:
            yield made(held)

    return given.mapInArrow(run, schema)


def _own_rows(sents: DataFrame, keywords: list[str], window: int, text_col: str) -> DataFrame:
    """(q, term, n): the counts beside each keyword, and as q null the sums of all terms' rows."""
    asked = list(keywords)

    def counts(terms, a, b):
        import pyarrow as pa

        sums = np.bincount(np.concatenate([a, b]), minlength=len(terms))
        wanted = np.isin(np.array(terms.to_pylist(), dtype=object), asked)
        there, back = wanted[a], wanted[b]
        keys, n = np.unique(np.concatenate([a[there] * len(terms) + b[there], b[back] * len(terms) + a[back]]), return_counts=True)
        q, ctx = np.divmod(keys, max(1, len(terms)))
        whole = np.flatnonzero(sums)
        names = pa.concat_arrays([pa.nulls(len(whole), pa.string()), terms.take(pa.array(q))])
        return pa.RecordBatch.from_arrays([names, terms.take(pa.array(np.concatenate([whole, ctx]))), pa.array(np.concatenate([sums[whole], n]))], names=["q", "term", "n"])

    return _counted(sents, text_col, window, counts, "q string, term string, n long").groupBy("q", "term").agg(F.sum("n").alias("n"))


def _placed(terms, ids: dict[str, int]):
    """(place of each term, the others' names): those with a number in its order, the others behind them by name."""
    at = np.array([ids.get(t, -1) for t in terms.to_pylist()], dtype=np.int64)
    rare = np.flatnonzero(at < 0)
    names = np.array(terms.to_pylist(), dtype=object)[rare]
    order = np.argsort(names)
    at[rare[order]] = len(ids) + np.arange(len(rare))
    return at, names[order]


def _pairs(first, second, whole):
    """(key, other, n) of pairs of places, the larger one first; a pair of one place counts twice, as both its sides are in one row."""
    keys, n = np.unique(np.maximum(first, second) * whole + np.minimum(first, second), return_counts=True)
    key, other = np.divmod(keys, max(1, whole))
    return key, other, np.where(key == other, 2 * n, n)


def _near(sents: DataFrame, place, window: int, text_col: str) -> DataFrame:
    """(key, ids, ns): counts of pairs with a frequent term, listed by the rarer one, the frequent ones as numbers.

    The numbers are in order of the counts, so a key's list has only terms more
    frequent than it, and none is listed by a term that is beside everything.
    """

    def counts(terms, a, b):
        import pyarrow as pa

        ids = place.value
        at, names = _placed(terms, ids)
        back = np.empty(len(ids) + len(names), dtype=np.int64)
        back[at] = np.arange(len(at))
        some = np.minimum(at[a], at[b]) < len(ids)
        key, other, n = _pairs(at[a[some]], at[b[some]], len(back))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        offsets = pa.array([*starts, len(key)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (other, n)]
        return pa.RecordBatch.from_arrays([terms.take(pa.array(back[key[starts]])), *lists], names=["key", "ids", "ns"])

    return _counted(sents, text_col, window, counts, "key string, ids array<int>, ns array<int>")


def _far(sents: DataFrame, place, window: int, text_col: str) -> DataFrame:
    """(key, other, n): counts of pairs of terms that are not frequent."""

    def counts(terms, a, b):
        import pyarrow as pa

        at, names = _placed(terms, place.value)
        first = len(place.value)
        rare = (at[a] >= first) & (at[b] >= first)
        key, other, n = _pairs(at[a[rare]] - first, at[b[rare]] - first, len(names))
        names = pa.array(names, pa.string())
        return pa.RecordBatch.from_arrays([names.take(pa.array(key)), names.take(pa.array(other)), pa.array(n, pa.int64())], names=["key", "other", "n"])

    return _counted(sents, text_col, window, counts, "key string, other string, n long")


def associates_of(sents: DataFrame, keywords: list[str], n: int = ASSOCIATES, least: int = LEAST, window: int = WINDOW, text_col: str = "sentence", tasks: int = 0, most: int = BROADCAST_ROWS) -> DataFrame:
    """``associates`` of one question from the sentences, with equal rows; no matrix is stored.

    The ``most`` most frequent terms are known to all tasks by number and count;
    an entry of two others meets their counts by shuffles.  ``tasks`` is a number
    that grows with the sentences, so that a task's share of the entries does not.
    """
    spark = sents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)
    own = materialize(_own_rows(sents, keywords, window, text_col), "own-rows")
    totals = own.where("q IS NULL").select("term", "n")
    whole = float(totals.agg(F.sum("n")).first()[0] or 0)
    first = [(i, r["term"], r["n"]) for i, r in enumerate(totals.orderBy(F.col("n").desc(), "term").limit(most).collect())]
    asked_totals = dict(totals.where(F.col("term").isin(*keywords)).collect())  # a row for each keyword
    lift = lambda n, a, b: F.log(n.cast("double") * F.lit(whole) / (a.cast("double") * b))
    of_q = F.create_map(*[F.lit(x) for pair in asked_totals.items() for x in pair])[F.col("q")] if asked_totals else F.lit(None).cast("long")
    rows = own.where("q IS NOT NULL").join(totals.withColumnRenamed("n", "n_ctx"), "term").select("q", "term", lift(F.col("n"), of_q, F.col("n_ctx")).alias("w")).where("w > 0")
    rows = materialize(rows, "asked")
    q_lengths = {r["q"]: r["s"] for r in rows.groupBy("q").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s")).collect()}
    # Each term with its count and its weights in the keywords' rows.
    known = materialize(totals.join(rows.groupBy("term").agg(F.collect_list(F.struct("q", "w")).alias("qs")), "term", "left"), "known-terms")
    numbered = spark.createDataFrame(first, "id int, term string, n long")
    side = materialize(numbered.select("id", "term").join(known, "term"), "frequent-terms")
    light = rows.join(F.broadcast(numbered.select("term")), "term", "left_semi").limit(10 * BROADCAST_ROWS + 1).count() <= 10 * BROADCAST_ROWS
    named = lambda df, end: df.select(*[F.col(c).alias(f"{c}_{end}" if c != "id" else c) for c in df.columns])

    place = spark.sparkContext.broadcast({t: i for i, t, _ in first})  # at most ``most``
    mine = named(known, "a").hint("shuffle_hash")
    near = _near(sents, place, window, text_col).repartition(parts, "key").select("key", F.explode(F.arrays_zip("ids", "ns")).alias("x")).groupBy("key", F.col("x.ids").alias("id")).agg(F.sum("x.ns").alias("n"))
    near = near.join(mine, F.col("key") == F.col("term_a")).join(F.broadcast(named(side, "b")) if light else named(side, "b"), "id")
    far = _far(sents, place, window, text_col).repartition(parts, "key").groupBy("key", "other").agg(F.sum("n").alias("n"))
    far = far.join(mine, F.col("key") == F.col("term_a")).join(named(known, "b"), F.col("other") == F.col("term_b"))

    def sums(entries: DataFrame) -> DataFrame:
        """(term, q, v): of each term's row the sum of squares (q null) and the products with the keywords' rows."""
        none = F.array().cast("array<struct<term:string,q:string,v:double>>")
        part = lambda term, q, v: F.struct(F.col(term).alias("term"), q.alias("q"), v.alias("v"))
        side_of = lambda term, qs: F.concat(F.array(part(term, F.lit(None).cast("string"), F.col("w") * F.col("w"))), F.coalesce(F.transform(qs, lambda x: part(term, x["q"], F.col("w") * x["w"])), none))
        weighed = entries.withColumn("w", lift(F.col("n"), F.col("n_a"), F.col("n_b"))).where("w > 0")
        both = F.concat(side_of("term_a", "qs_b"), F.when(F.col("term_a") == F.col("term_b"), none).otherwise(side_of("term_b", "qs_a")))
        return weighed.select(F.explode(both).alias("x")).groupBy("x.term", "x.q").agg(F.sum("x.v").alias("v"))

    added = materialize(sums(near).unionByName(sums(far)).groupBy("term", "q").agg(F.sum("v").alias("v")), "sums")
    lengths = added.where("q IS NULL").select("term", F.sqrt("v").alias("length"))
    dots = added.where("q IS NOT NULL").withColumnRenamed("v", "dot")
    able = known.where(F.col("n") >= least).where(~F.col("term").isin(*keywords)).select("term")
    own_length = F.create_map(*[F.lit(x) for pair in q_lengths.items() for x in pair])[F.col("q")] if q_lengths else F.lit(None).cast("double")
    scored = dots.join(lengths, "term").join(able, "term").select("q", "term", F.round(F.col("dot") / (F.col("length") * own_length), 6).alias("cosine"))
    return _best(scored, n)


def _best(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` best (q, term, cosine) of each keyword, ties by term."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("cosine").desc(), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("q").alias("term"), "rank", F.col("term").alias("associate"), "cosine")


def expanded(keywords: DataFrame, found: DataFrame) -> DataFrame:
    """A question's keyword table (term, ord, times) with its associates behind it, each once."""
    spark = keywords.sparkSession
    given = [(r["term"], r["ord"], r["times"]) for r in keywords.orderBy("ord").collect()]
    order = {t: o for t, o, _ in given}
    more = sorted({(order.get(r["term"], len(order)), r["rank"], r["associate"]) for r in found.collect()})  # n for each keyword
    last = max([o for _, o, _ in given], default=-1)
    extra = dict.fromkeys(t for _, _, t in more if t not in order)
    return spark.createDataFrame(given + [(t, last + 1 + i, 1) for i, t in enumerate(extra)], "term string, ord int, times long")
