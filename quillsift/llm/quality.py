"""Quality classifier: a factorisation machine.

    y(x) = b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The bracket (the sum-of-squares identity) gives all pairwise interactions in
time linear in the features.  Features are hashed words of the whole text
(square roots of relative frequencies), structure statistics and metadata
fields; the score is the logistic function of y.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, small_side, table
from .features import BLOCK, char_class, code_points, joined, word_hashes
from .langid import held_out

WORDS = 2048
FACTORS = 8
#: Bound of the sample that is learned from: documents, in the mean of a hash draw.
SAMPLE = 4000
STRUCTURE = (
    "log_chars", "log_words", "mean_word", "letters", "digits", "upper", "spaces", "marks", "other",
    "distinct_words", "top_word", "repeat_next", "lines", "distinct_lines", "mean_line", "long_words", "end_marks", "words_with_letter", "entropy",
)
#: Metadata: numeric fields have a feature each (by place), other values are hashed with their place.
NUMBERS = 16
METADATA = 64
DIMS = WORDS + len(STRUCTURE) + NUMBERS + METADATA
THRESHOLD = 0.3


def features(text: str | None, metadata=()) -> np.ndarray:
    """A text's vector; null counts as empty.  ``metadata`` are the fields' values, None where there is none.

    Numbers are scaled (signed logarithm), other values hashed with their place.
    """
    x = np.zeros(DIMS, dtype=np.float32)
    text = text or ""
    totals = np.zeros(7)

    def blocks():
        first = True  # whether a word may start at the next character
        for at in range(0, len(text), BLOCK):
            c = code_points(text[at : at + BLOCK])
            kinds = [char_class(k)[c] for k in ("isalpha", "isdigit", "isupper", "isspace")]
            marks = (c < 128) & ~kinds[0] & ~kinds[1] & ~kinds[3]
            totals[:] += [*(k.sum() for k in kinds), marks.sum(), len(c), (kinds[0] & np.append(first, kinds[3][:-1])).sum()]
            first = kinds[3][-1]
            yield c, kinds[3]

    words = joined(word_hashes(blocks()))
    with_letter = totals[6]
    n, m = totals[5], len(words)
    if m:
        counts = np.bincount((words >> np.uint64(20)).astype(np.int64) % WORDS, minlength=WORDS)
        x[:WORDS] = np.sqrt(counts / m)
        _, each = np.unique(words, return_counts=True)
        share = each / m
        lines = [s for s in text.split("\n") if s.strip()]
        stats = (
            np.log1p(n) / 10, np.log1p(m) / 8, min(n / m, 40) / 10, *(totals[:5] / n), max(0.0, n - totals[0] - totals[1] - totals[3] - totals[4]) / n,
            len(each) / m, share.max(), (words[1:] == words[:-1]).mean() if m > 1 else 0, np.log1p(len(lines)) / 6, len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))) / 8, min(1, (n - totals[3]) / m / 20), min(1, (text.count(".") + text.count("!") + text.count("?")) / m), with_letter / m, float(-(share * np.log(share)).sum()) / 8,
        )
        x[WORDS : WORDS + len(STRUCTURE)] = stats
    first = WORDS + len(STRUCTURE)
    for i, value in enumerate(metadata):
        if pd.isna(value):
            continue
        if isinstance(value, (int, float, np.number)):
            x[first + i % NUMBERS] += np.clip(np.sign(value) * np.log1p(abs(float(value))) / 10, -5, 5)
        else:
            x[first + NUMBERS + zlib.crc32(f"{i}:{value}".encode("utf-8", "surrogatepass")) % METADATA] += 1
    return x


class FactorisationMachine:
    def __init__(self, dims: int = DIMS, factors: int = FACTORS, seed: int = 0):
        self.b = np.float32(0)
        self.w = np.zeros(dims, dtype=np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (dims, factors)).astype(np.float32)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """By the sum-of-squares identity; x has a row for each document."""
        return self.b + x @ self.w + 0.5 * (((x @ self.v) ** 2).sum(axis=1) - (x**2) @ (self.v**2).sum(axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x).astype(np.float64), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.02, decay: float = 1e-4, batch: int = 256, seed: int = 0):
        """Logistic loss, Adam on seeded mini-batches; the classes keep their shares."""
        rng = np.random.default_rng(seed)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.b, self.w, self.v)]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                xb = x[pick]
                g = ((self.score(xb) - y[pick]) / len(pick)).astype(np.float32)
                xv = xb @ self.v
                grads = (g.sum(), xb.T @ g + decay * self.w, xb.T @ (g[:, None] * xv) - self.v * ((xb**2).T @ g)[:, None] + decay * self.v)
                t += 1
                for (name, grad), s in zip((("b", grads[0]), ("w", grads[1]), ("v", grads[2])), state):
                    s[0] = 0.9 * s[0] + 0.1 * grad
                    s[1] = 0.99 * s[1] + 0.01 * grad**2
                    new = getattr(self, name) - rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.99**t)) + 1e-8)
                    setattr(self, name, new.astype(np.float32))
        return self


def _vectors(batch: pd.DataFrame) -> list[np.ndarray]:
    meta = [c for c in batch.columns if c.startswith("meta")]
    return [features(t, row) for t, *row in zip(batch["text"], *[batch[c] for c in meta])]


def _picked(docs: DataFrame, text_col: str, metadata) -> list:
    number = {f.name for f in docs.schema.fields if isinstance(f.dataType, T.NumericType)}
    return [F.col(text_col).alias("text"), *[F.col(c).cast("double" if c in number else "string").alias(f"meta{i}") for i, c in enumerate(metadata)]]


def fit(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE, text_col: str = "text", metadata=("n_chars",)) -> FactorisationMachine | None:
    """Learn labels.quality of the documents where ``learn`` (a condition on doc_id) holds.

    The documents are drawn by a hash of their id, about ``sample`` in all;
    only their features come to the driver.  Of several rows of an id the one
    of the smallest text hash teaches, so a repeated id is one document.  Null labels, and labels without a
    document, count nowhere; equal labels of a document count once, unlike
    ones each.  Extra columns are not read.  None if nothing is labelled.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & learn).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    total = known.count()
    if not total:
        return None
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6 < min(1.0, sample / total))
    found = docs.select(F.col("doc_id"), *_picked(docs, text_col, metadata)).join(small_side(drawn), "doc_id")
    fields = [c for c in found.columns if c not in ("doc_id", "quality")]
    first = found.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), *fields)).alias("first"))
    rows = first.select("doc_id", "quality", "first.*")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "x": [v.tobytes() for v in _vectors(b)]})

    got = sorted(rows.mapInPandas(run, "doc_id long, quality int, x binary").collect(), key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    if not got:
        return None
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got])
    return FactorisationMachine().fit(x, np.array([float(r["quality"] == 1) for r in got], dtype=np.float32))


def score(docs: DataFrame, model: FactorisationMachine | None, id_col: str = "doc_id", text_col: str = "text", metadata=("n_chars",)) -> DataFrame:
    """(id, score) of every row, from its whole text and metadata; 0.5 if nothing was learned.

    Null and empty texts have scores too; repeated rows are scored each; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(rows: pd.DataFrame) -> pd.Series:
        model = shared.value
        if model is None:
            return pd.Series(0.5, index=rows.index)
        out = []
        for at in range(0, len(rows), 256):
            out.append(model.score(np.stack(_vectors(rows.iloc[at : at + 256]))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.select(F.col(id_col).alias("id"), F.struct(*_picked(docs, text_col, metadata)).alias("row")).select("id", run("row").alias("score"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    scored = score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
