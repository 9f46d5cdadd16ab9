"""Words of unspaced text: the best path over a dictionary's word graph.

The dictionary's words and their counts come from the corpus.  Every run of
letters and digits is a graph whose edges are the dictionary's words in it,
found by a prefix trie, and every single character, known or not; the weight of
an edge is the logarithm of its word's share of all counts.  The best path is
found from the right in one pass, so work is in proportion to the text times the
longest word.  Arrow batches; the trie is made once for each worker, as arrays,
and the runs of many texts are searched together, all places at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .topics import TERM

#: The most frequent words make the dictionary, which workers hold; runs and their longest words.
MOST = 200_000
LONGEST = 32
RUN = re.compile(r"[^\W]+")
#: Counts of a single character that the dictionary does not have.
UNKNOWN = 0.5


def dictionary(docs: DataFrame, most: int = MOST, text_col: str = "text") -> list[tuple[str, int]]:
    """The ``most`` most frequent terms (two letters or digits or more), ties by word, with their counts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(TERM), F.lit(0))).alias("word"))
    counted = words.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))
    return [(r["word"], r["n"]) for r in counted.orderBy(F.col("n").desc(), "word").limit(most).collect()]


@dataclass
class Segmenter:
    """Words with counts, as a trie: a node's "" is the weight of the word that ends there."""

    words: list[tuple[str, int]]

    def __post_init__(self):
        self.total = math.log(max(1, sum(n for _, n in self.words)))
        self.unknown = math.log(UNKNOWN) - self.total
        self.trie: dict = {}
        for word, n in self.words:
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = math.log(n) - self.total

    def best(self, run: str) -> list[str]:
        """The words of a run whose weights sum up highest, ties to the longer first word."""
        n = len(run)
        score, ends = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            node = self.trie.get(run[i])
            best, end = self.unknown + score[i + 1], i + 1
            j = i + 1
            while node is not None:
                weight = node.get("")
                if weight is not None and weight + score[j] >= best:
                    best, end = weight + score[j], j
                if j == n:
                    break
                node = node.get(run[j])
                j += 1
            score[i], ends[i] = best, end
        out, i = [], 0
        while i < n:
            out.append(run[i : ends[i]])
            i = ends[i]
        return out

    def words_of(self, text: str) -> list[str]:
        return [w for run in RUN.findall(text.lower()) for w in self.best(run)]


#: Characters that are searched together; a longer run than LONG goes by itself, as steps are as many as the longest has characters.
TOGETHER, LONG = 100_000, 2_000
#: A multiplier that spreads keys over a table (odd, 64 bits).
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Links:
    """Numbers of distinct whole keys, -1 for others: tables of places, keys whose place was taken go to the next, smaller one."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, left = keys, [], np.arange(len(keys), dtype=np.int32)
        while len(left) or not self.tables:
            bits = max(8, int(len(left) * 4).bit_length())
            table, at = np.full(1 << bits, -1, dtype=np.int32), self._place(keys[left], bits, len(self.tables))
            table[at] = left
            self.tables.append((bits, table))
            left = left[table[at] != left]

    @staticmethod
    def _place(keys: np.ndarray, bits: int, turn: int) -> np.ndarray:
        return ((keys.astype(np.uint64) + np.uint64(turn)) * SPREAD * (SPREAD if turn % 2 else np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        left = None
        for turn, (bits, table) in enumerate(self.tables):
            asked = keys if left is None else keys[left]
            got = table[self._place(asked, bits, turn)]
            hit = (got >= 0) & (self.keys[got] == asked) if len(self.keys) else np.zeros(len(asked), dtype=bool)
            if left is None:
                out[hit] = got[hit]
                left = np.flatnonzero((got >= 0) & ~hit)
            else:
                out[left[hit]] = got[hit]
                left = left[(got >= 0) & ~hit]
            if not len(left):
                break
        return out


class Together:
    """A Segmenter's answers for many runs at once, by the trie as arrays."""

    def __init__(self, segmenter: Segmenter):
        self.one = segmenter
        letters = sorted({c for w, _ in segmenter.words for c in w})
        self.letter = np.full(0x110000, len(letters), dtype=np.int64)  # unknown ones have no links
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.width = len(letters) + 1
        # Nodes by steps: (number of the node before, letter) -> node.
        nodes, weights, keys, self.names = [(segmenter.trie, 0)], [np.nan], [], [""]
        place = {c: i for i, c in enumerate(letters)}
        for node, number in nodes:
            for c, child in node.items():
                if c != "":
                    keys.append(number * self.width + place[c])
                    weights.append(child.get("", np.nan))
                    self.names.append(self.names[number] + c)
                    nodes.append((child, len(nodes)))
        self.links, self.weights = Links(np.array(keys, dtype=np.int64)), np.array(weights)
        self.is_word = ~np.isnan(self.weights)

    def edges(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, node) of the dictionary's words at all places, shorter ones first; none goes over a place that has no letter of theirs."""
        at, node, n, found = np.arange(len(letters)), np.zeros(len(letters), dtype=np.int64), 0, []
        while len(at):
            link = self.links.find(node * self.width + letters[at + n])
            n += 1
            on = np.flatnonzero(link >= 0)
            at, node = at[on], link[on] + 1
            word = np.flatnonzero(self.is_word[node])
            found.append((at[word], np.full(len(word), n), node[word]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def paths(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run, start, stop, node) of the words of each run as ``best`` has them, places being those of the runs with a line end behind each; node 0 is a single character that is no word."""
        sizes = np.array([len(r) for r in runs])
        letters = self.letter[np.frombuffer("".join([r + "\n" for r in runs]).encode("utf-32-le"), dtype=np.uint32)]
        bounds = np.cumsum(sizes + 1) - 1  # the line ends, which no word has
        left = np.repeat(bounds, sizes + 1) - np.arange(len(letters))
        places = np.argsort(left, kind="stable")
        turn = np.empty(len(places), dtype=np.int64)
        turn[places] = np.arange(len(places))
        start, length, node = self.edges(letters)
        order = np.argsort(turn[start], kind="stable")
        start, node = start[order], node[order]
        stop, weight, first = start + length[order], self.weights[node], np.flatnonzero(np.diff(turn[start], prepend=-1))
        counts = np.diff(np.append(first, len(start)))
        cuts = np.searchsorted(left[places], np.arange(1, sizes.max() + 2))
        group_cuts = np.searchsorted(left[start[first]], np.arange(1, sizes.max() + 2))
        edge_cuts = np.append(first, len(start))[group_cuts]
        score, best, by = np.zeros(len(letters)), np.arange(1, len(letters) + 1), np.zeros(len(letters), dtype=np.int64)
        for i in range(len(cuts) - 1):  # characters to the run's end
            here = places[cuts[i] : cuts[i + 1]]
            score[here] = self.one.unknown + score[here + 1]
            a, b, g, h = edge_cuts[i], edge_cuts[i + 1], group_cuts[i], group_cuts[i + 1]
            if a == b:
                continue
            at = start[first[g:h]]
            sums = weight[a:b] + score[stop[a:b]]
            most = np.maximum(np.maximum.reduceat(sums, first[g:h] - a), score[at])
            is_best = np.flatnonzero(sums == np.repeat(most, counts[g:h])) + a
            score[at] = most
            best[start[is_best]], by[start[is_best]] = stop[is_best], node[is_best]  # the longest is the last
        at, of, found = bounds - sizes, np.arange(len(runs)), []
        while len(at):
            inside = np.flatnonzero(at < bounds[of])
            at, of = at[inside], of[inside]
            found.append((of, at, best[at], by[at]))
            at = best[at]
        return tuple(np.concatenate(x) for x in zip(*found))

    def counted(self, texts: list[str | None]) -> list[tuple[np.ndarray, list[str], np.ndarray]]:
        """(text, word, n): the counts of ``words_of`` each text, in parts; a null text has none."""
        runs = sorted(((i, r) for i, t in enumerate(texts) if t is not None for r in RUN.findall(t.lower())), key=lambda x: len(x[1]))  # as many steps as the longest needs
        out, held, n = [], [], 0

        def search():
            joined = np.array(list("".join([r + "\n" for _, r in held])), dtype="U1")
            of, at, _, node = self.paths([r for _, r in held])
            of = np.array([i for i, _ in held])[of]
            code = np.where(node > 0, node, -1 - joined[at].view(np.uint32).astype(np.int64))
            wide = len(self.names) + 0x110000
            keys, counts = np.unique(of * wide + code + 0x110000, return_counts=True)
            of, code = keys // wide, keys % wide - 0x110000
            out.append((of, [self.names[c] if c > 0 else chr(-1 - c) for c in code.tolist()], counts))

        for i, run in runs:
            if len(run) > LONG:
                words, counts = np.unique(np.array(self.one.best(run), dtype=object), return_counts=True)
                out.append((np.full(len(words), i), words.tolist(), counts))
                continue
            held.append((i, run))
            n += len(run)
            if n >= TOGETHER:
                search()
                held, n = [], 0
        if held:
            search()
        return out


def segmenter(words: list[tuple[str, int]]) -> Callable:
    """A column function: the words of a text as an array; a null text has none."""
    held: dict = {}

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        if "made" not in held:
            held["made"] = Segmenter(words)
        return pd.Series([[] if t is None else held["made"].words_of(t) for t in texts], dtype=object)

    return run


#: The last dictionary of a worker, which outlives its tasks.
_made: dict[str, Together] = {}


def term_counts(docs: DataFrame, words: list[tuple[str, int]], text_col: str = "text") -> DataFrame:
    """documents(doc_id, text) -> (doc_id, term, n): the counts of a segmenter's words, in parts that are added up."""
    name, given = uuid4().hex, docs.schema["doc_id"]

    def run(batches):
        import pyarrow as pa

        if name not in _made:
            _made.clear()
            _made[name] = Together(Segmenter(words))
        for batch in batches:
            ids = batch.column("doc_id")
            for of, terms, counts in _made[name].counted(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "term", "n"])

    schema = StructType([StructField("doc_id", given.dataType), StructField("term", StringType()), StructField("n", LongType())])
    return docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(run, schema).groupBy("doc_id", "term").agg(F.sum("n").alias("n"))
