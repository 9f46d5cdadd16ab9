"""Language identification in two steps.

First the language family is predicted (one linear support vector machine for
each family, highest margin wins), then one-versus-one linear support vector
machines separate the languages within it, by votes and then by margin.
Features are hashed letter trigrams of the whole text, as square roots of
relative frequencies (unit length).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .features import letter_grams

DIMS = 4096
#: Bounds of the sample that the machines learn from: documents of each language, and of all (but LEAST of each language).
SAMPLE = 500
TOTAL = 10_000
LEAST = 20
UNKNOWN = "und"

# Families of common language codes; others form a family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc rm",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "indic": "hi bn mr ne pa gu ur si",
    "turkic": "tr az kk uz ky tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def features(text: str) -> np.ndarray:
    counts = np.sqrt(letter_grams(text, DIMS))
    return (counts / (np.sqrt((counts**2).sum()) or 1.0)).astype(np.float32)


def letters_in(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights (last: bias) of a linear machine with squared hinge loss, by accelerated gradient steps; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)]).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1.0 / (1.0 + 4.0 * c)  # |x|^2 is 2, weights sum to 1
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    for t in range(steps):
        miss = np.maximum(0, 1 - y * (x @ v))
        grad = v / c - 2 * ((weight * miss * y) @ x)
        new = v - np.float32(step * c) * grad
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


class Model:
    """Family machines, and pairwise machines within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.members: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        self.families = sorted(self.members)
        of = np.array([FAMILY_OF.get(k, k) for k in langs])
        lang = np.array(langs)
        sign = lambda hit: np.where(hit, 1, -1).astype(np.float32)
        self.top = np.stack([train_svm(x, sign(of == f)) for f in self.families], axis=1) if len(self.families) > 1 else None
        self.pairs = {
            (a, b): train_svm(x[m := (lang == a) | (lang == b)], sign(lang[m] == a))
            for codes in self.members.values()
            for a, b in itertools.combinations(codes, 2)
        }

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """(language, score): the score grows with the smallest margin on the way."""
        x = np.append(x, np.float32(1))
        margin = 4.0
        family = self.families[0]
        if self.top is not None:
            m = x @ self.top
            order = np.argsort(-m, kind="stable")
            family, margin = self.families[order[0]], float(m[order[0]] - m[order[1]]) / 2
        codes = self.members[family]
        votes = {k: [0, 0.0] for k in codes}
        for a, b in itertools.combinations(codes, 2):
            m = float(x @ self.pairs[a, b])
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = max(codes, key=lambda k: (*votes[k], [-ord(c) for c in k]))
        if len(codes) > 1:
            margin = min(margin, min(float(x @ self.pairs[min(best, k), max(best, k)]) * (1 if best < k else -1) for k in codes if k != best))
        return best, float(1 / (1 + np.exp(-4 * np.clip(margin, -8, 8))))


def fit(docs: DataFrame, learn, sample: int = SAMPLE, total: int = TOTAL) -> Model | None:
    """Learn from rows where the condition ``learn`` holds and lang is not null; None if there are none.

    The rows are drawn by a hash of the text, about ``sample`` for each
    language (all, where there are fewer), and fewer of each where there are so
    many languages that these would be more than ``total``; no language is left
    out.  Equal texts count once, before anything is collected.  Only the features of these rows come to the driver, as the numbers
    that are not zero.  Texts without a letter teach nothing.
    """
    small_batches(docs.sparkSession)
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = known.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    if not counts:
        return None
    sample = min(sample, max(LEAST, total // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["count"]))])
    drawn = known.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1e6 < share[F.col("lang")]).dropDuplicates(["lang", "text"])

    def run(batches):
        for b in batches:
            xs = [features(t) for t in b["text"]]
            at = [np.flatnonzero(x).astype(np.uint16) for x in xs]
            yield pd.DataFrame({"lang": b["lang"], "at": [i.tobytes() for i in at], "x": [x[i].tobytes() for x, i in zip(xs, at)]})[[len(i) > 0 for i in at]]

    rows = sorted({(r["lang"], bytes(r["at"]), bytes(r["x"])) for r in drawn.mapInPandas(run, "lang string, at binary, x binary").collect()})
    kept, seen = [], {}
    for r in rows:  # the draw's mean is the sample's size
        seen[r[0]] = seen.get(r[0], 0) + 1
        if seen[r[0]] <= 2 * sample:
            kept.append(r)
    if not kept:
        return None
    x = np.zeros((len(kept), DIMS), dtype=np.float32)
    for row, (_, at, values) in zip(x, kept):
        row[np.frombuffer(at, dtype=np.uint16)] = np.frombuffer(values, dtype=np.float32)
    return Model(x, [r[0] for r in kept])


def has_letter(text_col: str) -> F.Column:
    """Whether the text is not null and has a letter, as identify() sees it."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([letters_in(t) for t in texts], dtype=bool)

    return run(text_col)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned.  ``id`` may be any column, a struct of all others included.
    Repeated rows are predicted each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    # A filter on the result would else be pushed below and the texts judged twice, by twice as many workers.
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        out = [model.predict(features(t)) if model is not None and letters_in(t) else (UNKNOWN, 0.0) for t in texts]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return picked.withColumn("p", predict.asNondeterministic()("text")).select("id", "p.lang_pred", "p.score")


def held_out(modulus: int, rest: int, id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == rest, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out(4, 2))
    return identify(docs, model).select(F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
