"""Dense search by blocked matrix products.

A block of questions is a matrix that every task holds; an Arrow batch of
vectors is another, and one product scores them all.  A task keeps, for each
question, the rows whose score comes near its k-th best (rounding errors of the
product allowed for), and of equal vectors only the k smallest keys, so a vector
that comes a million times takes k places.  What is left is scored again by the
exact expression and ranked, so results are those of the expression alone.

Vectors that a product cannot take (null, of another length, with a null or a
component that is not finite) go to the expression as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Share of the largest possible score by which a product may differ from the exact one; errors are far below it.
SLACK = 1e-9
#: Scores that are held at a time.
CELLS = 1 << 22
METRICS = ("cosine", "dot", "l2_squared")


def takes(vectors: DataFrame, key: str, metric: str) -> bool:
    return metric in METRICS and isinstance(vectors.schema[key].dataType, IntegralType)


def sound(vector: Column, width: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & fine, F.lit(False))


class Nearest:
    """The candidates of a task: for each question the k best rows and all that come within the slack of the k-th."""

    def __init__(self, questions: np.ndarray, k: int, metric: str):
        self.k, self.metric = k, metric
        length = np.linalg.norm(questions, axis=1)
        self.q = questions / np.where(length > 0, length, 1)[:, None] if metric == "cosine" else questions
        self.length = length
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, questions.shape[1]))]
        self.least = np.full(len(questions), -np.inf)

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of every question and row, the larger the nearer; slack of each question)."""
        norms = np.linalg.norm(x, axis=1)
        if self.metric == "cosine":
            return self.q @ (x / np.where(norms > 0, norms, 1)[:, None]).T, np.full(len(self.q), SLACK)
        top = norms.max(initial=0.0)
        if self.metric == "dot":
            return self.q @ x.T, SLACK * (1e-300 + self.length * top)
        far = (self.length**2)[:, None] + (norms**2)[None] - 2 * (self.q @ x.T)
        return -far, SLACK * (self.length + top) ** 2

    def add(self, keys: np.ndarray, x: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(self.q)))
        for at in range(0, len(keys), step):
            part, ids = x[at : at + step], keys[at : at + step]
            score, slack = self.scores(part)
            near = self.least
            if len(ids) >= self.k:
                near = np.maximum(near, np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * slack)
            rows, columns = np.nonzero(score >= near[:, None])
            if len(rows):
                self._merge(rows, ids[columns], score[rows, columns], part[columns], slack)

    def _merge(self, rows, keys, score, x, slack) -> None:
        rows, keys, score, x = (np.concatenate([a, b]) for a, b in zip(self.held, (rows, keys, score, x)))
        # Of equal vectors the k smallest keys stay.
        _, same = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((keys, same.ravel(), rows))
        rows, keys, score, x, same = rows[order], keys[order], score[order], x[order], same.ravel()[order]
        keep = _place(rows * (len(same) + 1) + same) < self.k
        rows, keys, score, x = rows[keep], keys[keep], score[keep], x[keep]
        order = np.lexsort((-score, rows))
        rows, keys, score, x = rows[order], keys[order], score[order], x[order]
        kth = _place(rows) == self.k - 1
        self.least[rows[kth]] = np.maximum(self.least[rows[kth]], score[kth] - 2 * slack[rows[kth]])
        keep = score >= self.least[rows]
        self.held = [rows[keep], keys[keep], score[keep], x[keep]]


def _place(groups: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal neighbours."""
    if not len(groups):
        return groups
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(groups)]])))


def candidates(vectors: DataFrame, questions: list, k: int, metric: str, key: str) -> DataFrame:
    """vectors(key, v: array<double>), sound ones -> (query_row, key, v) that can be among the k nearest; questions are a block's vectors."""
    held = np.array(questions, dtype=np.float64)

    def run(batches):
        import pyarrow as pa

        found = Nearest(held, k, metric)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                found.add(batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64), x)
        rows, keys, _, x = found.held
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(keys, pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], names=["query_row", key, "v"])

    return vectors.select(key, "v").mapInArrow(run, f"query_row int, `{key}` long, v array<double>")
