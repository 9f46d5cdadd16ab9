"""Packing ranked sentences into a character budget, and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 1000
HEADER = "Answer the question from the passages below. Leave out passages that do not bear on it. Passages: "
QUESTION = " Question: "


def pack(rows: DataFrame, order: list, limit: int = LIMIT, separator: int = 1, initial: int = 0, text_col: str = "sentence") -> DataFrame:
    """The leading rows while what stands before them is no longer than ``limit`` characters.

    So the last row may overshoot, and a buffer of exactly the limit takes one
    more.  Every row has a character or a separator, so limit + 2 rows are the
    most that can fit; only those reach the single-partition window.
    """
    best = rows.orderBy(*order).limit(limit + 2)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text_col) + separator).over(before), F.lit(0)) + initial
    return best.withColumn("used", used).withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("used") <= limit)


def pack_keys(keys: DataFrame, texts: DataFrame, on: list[str], order: list, limit: int = LIMIT, **how) -> DataFrame:
    """``pack`` of rows whose text stands in another table: the limit + 2 best keys are looked up in ``texts`` by a broadcast."""
    best = keys.orderBy(*order).limit(limit + 2)
    return pack(texts.join(F.broadcast(best), on), order, limit, **how)


def prompt(packed: DataFrame, question: str, header: str = HEADER, text_col: str = "sentence", separator: str = " ") -> DataFrame:
    """One row (prompt): header, context, question.  ``packed`` is bounded by its budget."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", text_col))), lambda x: x[text_col])
    return packed.agg(F.concat(F.lit(header), F.trim(F.array_join(ordered, separator)), F.lit(QUESTION + question)).alias("prompt"))
