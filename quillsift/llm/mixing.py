"""Mixing sources to target weights by capped water-filling.

A source gets words in proportion to its weight, but never more than
``max_epochs`` times what it has.  What a clamped source cannot take goes to
the others in proportion to their weights, until no source is above its cap:
sorted by cap / weight, the water level follows from prefix sums, so no
iteration is needed.  Each source is then taken in whole repetitions plus a
seeded fractional one: the documents that come first in hash order up to the
remaining words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side, table, text_hash60

#: ASCII white space, as the contract of the word count has it.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKET_BITS = 16
#: Buckets are cut in two steps, so that no task takes more than 2^8 of a source's.
COARSE_BITS = 8


def word_count(text) -> F.Column:
    """Words of a text; null counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def water_fill(sizes: DataFrame, budget_ratio: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """sizes(source, source_size) -> the same with ``target`` (double).

    Sources are numbered by code point with null last; source i weighs
    ``weights[i % len(weights)]``.  The table has a row for each source, so its
    global windows are as small as the number of sources.  A source of size 0
    gets 0.  If the budget exceeds all caps, every source gets its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(budget_ratio)))
        .withColumn("place", F.row_number().over(by_level))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("fits", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level")))
        .withColumn("level", F.min("fits").over(every)["level"])
        .withColumn("target", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def _hashed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with the place of every row in its source's hash order: h, and its leading bits as bucket."""
    return docs.withColumn("h", text_hash60(F.lit(seed), F.col("doc_id"))).withColumn("bucket", F.shiftright("h", 60 - BUCKET_BITS).cast("int"))


def _plan(sized: DataFrame, budget_ratio: float, max_epochs: float, weights) -> DataFrame:
    """A row for each source: target, whole epochs, words of the fractional one, and the bucket where those end.

    ``cross`` is that bucket, ``before`` the words in earlier ones.
    """
    buckets = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    targets = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), budget_ratio, max_epochs, weights)
    plan = targets.withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")).withColumn(
        "more", F.col("target") - F.col("whole") * F.col("source_size")
    )
    known = small_side(plan).alias("p")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))

    def crossing(rows: DataFrame, key: str) -> DataFrame:
        """(source, at, before): the first bucket after which the words are more than ``more``; rows also have ``base``, the words in front."""
        so_far = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)  # at most 2^8 rows
        summed = rows.withColumn("after", F.col("base") + F.sum("words").over(so_far)).alias("b").join(known, same("b", "p")).where(F.col("after") > F.col("more"))
        first = summed.groupBy("b.source").agg(F.min(F.struct(F.col(key), (F.col("after") - F.col("words")).alias("before"))).alias("x"))
        return first.select("source", F.col(f"x.{key}").alias("at"), "x.before")

    parts = buckets.withColumn("coarse", F.shiftright("bucket", BUCKET_BITS - COARSE_BITS))
    coarse = crossing(parts.groupBy("source", "coarse").agg(F.sum("words").alias("words")).withColumn("base", F.lit(0).cast("long")), "coarse")
    inside = parts.alias("b").join(small_side(coarse).alias("c"), same("b", "c") & (F.col("b.coarse") == F.col("c.at"))).select("b.source", "bucket", "words", F.col("before").alias("base"))
    cross = crossing(inside, "bucket").select("source", F.col("at").alias("cross"), "before").alias("c")
    return materialize(plan.alias("p").join(cross, same("p", "c"), "left").select("p.*", "c.cross", "c.before"), "mix-plan")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    side = small_side(plan).alias("p")
    return rows.alias("s").join(side, F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.*", "p.source_size", "p.target", "p.whole", "p.more", "p.cross", "p.before")


ON_CROSS = "coalesce(bucket = cross, false)"
BELOW_CROSS = "CAST(coalesce(more > 0 AND bucket < cross, false) AS BIGINT)"


def _inside(joined: DataFrame) -> DataFrame:
    """The rows of crossing buckets, with ``extra``: 1 if the fractional epoch takes them."""
    earlier = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return joined.where(ON_CROSS).withColumn("extra", ((F.col("more") > 0) & (F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.col("size") / 2 <= F.col("more"))).cast("long"))


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return materialize(_hashed(rows, seed), "mix")


def mix(docs: DataFrame, budget_ratio: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Repetitions of every document: (doc_id, size, source_size, target, taken, repeats).

    ``repeats`` is the whole number of epochs of its source, plus 1 for the
    documents that the fractional epoch takes.  A source's taken words differ
    from its target by at most half of one document.  Other input columns are
    not used, so their names cannot clash.

    Null text has size 0; null source is a source of its own; repeated rows
    count as documents of their own, and equal rows differ in nothing but their
    repeats.  An empty table gives an empty result.

    Only the crossing bucket of a source's hash order (1 in 65,536) is sorted;
    all other documents are decided by their bucket alone, so a hot source
    needs neither a sort nor a shuffle of its rows.
    """
    sized = _sized(docs, seed, id_col, text_col, source_col)
    joined = _with_plan(sized, _plan(sized, budget_ratio, max_epochs, weights))
    outside = joined.where(f"NOT {ON_CROSS}").withColumn("extra", F.expr(BELOW_CROSS))
    repeats = F.col("whole") + F.col("extra")
    return _inside(joined).unionByName(outside).select("doc_id", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats.alias("repeats"))


def repeat_documents(docs: DataFrame, budget_ratio: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS, seed: int = 0) -> DataFrame:
    """documents with every row as often as ``mix`` has it; rows of 0 repeats go.

    The texts stay where they are: only the rows of crossing buckets are looked
    up by id.  Rows of one id in one crossing bucket share a decision.  Null
    ids, texts and sources are as in ``mix``; empty documents come no more often
    than others of their source; an empty table gives an empty result.
    """
    sized = _sized(docs, seed, "doc_id", "text", "source")
    plan = _plan(sized, budget_ratio, max_epochs, weights)
    extra = materialize(_inside(_with_plan(sized, plan)).groupBy("source", "doc_id").agg(F.max("extra").alias("extra")), "mix-extra")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"))
    placed = _with_plan(_hashed(packed, seed), plan).alias("s")
    looked = placed.join(small_side(extra).alias("x"), F.col("s.doc_id").eqNullSafe(F.col("x.doc_id")) & F.col("s.source").eqNullSafe(F.col("x.source")) & F.expr("coalesce(s.bucket = s.cross, false)"), "left")
    times = looked.select("s.row", (F.col("whole") + F.when(F.expr(ON_CROSS), F.coalesce("extra", F.lit(0))).otherwise(F.expr(BELOW_CROSS))).cast("int").alias("times"))
    return times.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, row_number() OVER o AS place,
             (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
lev AS (SELECT min_by(level, place) AS level FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM lev) * weight, cap), cap) AS target FROM w),
p AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
d AS (SELECT sized.doc_id, sized.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS more,
             coalesce(sum(sized.size) OVER (PARTITION BY sized.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized JOIN p ON sized.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       whole + (CASE WHEN more > 0 AND before + size / 2 <= more THEN 1 ELSE 0 END)::BIGINT AS repeats,
       ((whole + (CASE WHEN more > 0 AND before + size / 2 <= more THEN 1 ELSE 0 END)) * size)::BIGINT AS taken
FROM d
"""
