"""SentencePiece encoding and decoding, with N-best segmentation.

A text becomes " " + text with every space as the mark U+2581; its
segmentations into pieces are the paths of a lattice, and a path scores the
sum of its pieces.  The forward Viterbi scores of the lattice are, for a search
that runs backward from its end, the exact score of the best rest.  So A* with
them as heuristic pops whole segmentations in order of score: the first N are
the N best.  As the heuristic is exact, every entry of the frontier leads to a
path of just its priority, so a frontier of N entries is enough.

Where no piece reaches across a place (before a mark that follows another
character, and around characters that no longer piece holds) all paths meet,
so the lattice is a chain of parts.  Parts repeat (most are words), and each is
solved once and remembered: A* pops its best segmentation, and the best entry
that is left in the frontier says what the second best would lose.  Many parts
of one length are searched in lockstep, by tables.  The N best of a chain come
from the N best of its parts (A* again, for the few parts that can differ),
best first.

A character without a piece becomes its UTF-8 bytes, at the score UNKNOWN below the
worst piece.  The mark itself, where a text has it, becomes bytes too, so decoding is exact.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, table, text_slices

MARK = "▁"
UNKNOWN = 10.0
#: Parts that a worker remembers before it starts anew, and the bytes of these.
CACHE = 100_000
CACHE_BYTES = 32_000_000
N_BEST = 3
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The longest part and the most parts of a table that are searched in lockstep.
LONGEST = 24
ROWS = 4096
#: Stands for a mark that the text itself holds, until it becomes bytes (a code point that no text can hold).
OWN_MARK = "\udc81"


class Vocabulary:
    """Pieces with scores, the bytes of every id, and the search over the lattice."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: (piece, score, kind) by id; kind is normal, byte or other (never used)."""
        self.score = {p: (s, i) for i, (p, s, k) in enumerate(pieces) if k == "normal"}
        self.byte_id = {int(p[3:5], 16): i for i, (p, s, k) in enumerate(pieces) if k == "byte"}
        self.raw = [p.replace(MARK, " ").encode() if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte" else b"" for p, s, k in pieces]
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - UNKNOWN
        self.longest = max(map(len, self.score), default=1)
        joined = {c for p in self.score if len(p) > 1 for c in p}
        self.whole_marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score)
        # Parts: a run of marks with what follows; a character that stands in no longer piece is a part of its own.
        inside = "".join(map(re.escape, sorted(joined - {MARK})))
        self.split = re.compile((f"{MARK}*[{inside}]+|" if inside else "") + f"{MARK}+|[^{inside}{MARK}]") if self.whole_marks else re.compile(r"(?s).+")
        self._tables(joined)
        self.forget()

    def _tables(self, joined: set[str]) -> None:
        """The trie as arrays, for pieces of characters below U+3000 that are pieces themselves.

        ``column`` numbers these characters.  Nodes with children come first
        and have a row each in ``following``; the row after them, of dead ends
        (node ``dead``), is that of all others.
        """
        known = sorted(c for c in self.score if len(c) == 1 and ord(c) < 0x3000 and (c in joined or ord(c) < 0x180))
        self.column = np.full(0x3000, -1, dtype=np.int16)
        self.column[[ord(c) for c in known]] = np.arange(len(known))
        place = {c: i for i, c in enumerate(known)}
        usable = [p for p in self.score if all(c in place for c in p)]
        inner = {p[:i] for p in usable for i in range(len(p))} or {""}
        number = {p: i for i, p in enumerate([*sorted(inner), *(p for p in usable if p not in inner)])}
        self.inner, self.dead = len(inner), len(number)
        self.following = np.full((self.inner + 1, max(1, len(known))), self.dead, dtype=np.uint16 if self.dead < 65536 else np.int32)
        self.node_score = np.full(self.dead + 1, -np.inf)
        self.node_id = np.zeros(self.dead + 1, dtype=np.uint32)
        for p, i in number.items():
            if p:
                self.following[number[p[:-1]], place[p[-1]]] = i
            if p in self.score:
                self.node_score[i], self.node_id[i] = self.score[p]

    def forget(self) -> None:
        """Start without remembered parts: place by part, and by place ids, score and loss of the second best."""
        self.place: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.scores = np.zeros(1024)
        self.losses = np.zeros(1024)
        self.held = 0

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        return cls([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "ids", "scores", "losses", "held")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def edges(self, part: str, at: int):
        """(end, score, ids) of the pieces that start at a place."""
        out = []
        for end in range(at + 1, min(len(part), at + self.longest) + 1):
            if (got := self.score.get(part[at:end])) is not None:
                out.append((end, got[0], (got[1],)))
        if not out or out[0][0] != at + 1:
            out.append((at + 1, self.unknown, self._bytes(part[at])))
        return out

    def _bytes(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in (MARK if c == OWN_MARK else c).encode("utf-8", "surrogatepass"))

    def _ending(self, part: str, end: int) -> list[tuple[int, float, int]]:
        """(start, score, id) of the pieces that end at a place; the id of a character without a piece is -end."""
        out = []
        for start in range(max(0, end - self.longest), end):
            if (got := self.score.get(part[start:end])) is not None:
                out.append((start, *got))
        if not out or out[-1][0] != end - 1:
            out.append((end - 1, self.unknown, -end))
        return out

    def search(self, part: str, n: int) -> tuple[list[tuple[float, bytes]], float]:
        """The n best segmentations (score, ids) of a part, and the score of the next (-inf if there is none).

        Backward A*; equally good ones come in a fixed order (the latest entry
        first, the longest piece last in it), which is that of search_many.
        Nothing of the lattice is held but a score for each place.
        """
        size = len(part)
        forward = array("d", bytes(8 * (size + 1)))
        for end in range(1, size + 1):
            forward[end] = max(forward[start] + s for start, s, _ in self._ending(part, end))
        above, piece = array("q"), array("q")  # of the entries that were popped: the one before, and the piece between
        frontier = [(-forward[size], 0, size, 0.0, -1, None)]
        pushed, found = 0, []
        while frontier and len(found) < n:
            _, _, at, done, node, code = frontier.pop(0)
            if code is not None:
                above.append(node)
                piece.append(code)
                node = len(above) - 1
            if at == 0:
                found.append((done, self._path(part, above, piece, node)))
                continue
            for start, s, more in reversed(self._ending(part, at)):
                pushed += 1
                bisect.insort(frontier, (-(forward[start] + s + done), -pushed, start, s + done, node, more))
            del frontier[n + 1 - len(found) :]
        return found, -frontier[0][0] if frontier else -np.inf

    def _path(self, part: str, above: array, piece: array, node: int) -> bytes:
        ids = array("I")
        while node >= 0:
            code = piece[node]
            ids.extend((code,) if code >= 0 else self._bytes(part[-code - 1]))
            node = above[node]
        return np.asarray(ids, dtype="<u4").tobytes()

    def remember(self, part: str, ids: bytes, score: float, loss: float) -> None:
        place = self.place[part] = len(self.ids)
        if place == len(self.scores):
            self.scores, self.losses = np.resize(self.scores, 2 * place), np.resize(self.losses, 2 * place)
        self.ids.append(ids)
        self.scores[place], self.losses[place] = score, loss
        self.held += 250 + 2 * len(part) + len(ids)

    def solve(self, part: str) -> None:
        """Search a part and remember it."""
        ((score, ids),), second = self.search(part, 1)
        self.remember(part, ids, score, score - second)

    def solve_many(self, parts) -> None:
        """The same for many parts: those of equal length in lockstep."""
        by_size: dict[int, list[str]] = {}
        for p in parts:
            by_size.setdefault(len(p), []).append(p)
        for size, group in by_size.items():
            if size > LONGEST or len(group) < 8:
                for p in group:
                    self.solve(p)
                continue
            for at in range(0, len(group), ROWS):
                some = group[at : at + ROWS]
                points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(some), size)
                chars = np.where(points < len(self.column), self.column[np.minimum(points, len(self.column) - 1)], -1)
                plain = (chars >= 0).all(axis=1)
                for i in np.flatnonzero(~plain):
                    self.solve(some[i])
                if plain.any():
                    self._search_many([some[i] for i in np.flatnonzero(plain)], chars[plain])

    def _search_many(self, parts: list[str], chars: np.ndarray) -> None:
        """A* for one best segmentation of each row, all rows in lockstep.

        The frontier's best entry is always one of those just pushed, so a row
        goes from place to place backward; of all others the best score is kept.
        """
        rows, size = chars.shape
        forward = np.full((size + 1, rows), -np.inf)
        forward[0] = 0
        ending: list[list] = [[] for _ in range(size + 1)]  # (start, score of the piece or -inf, its id), over all rows
        for start in range(size):
            node = np.zeros(rows, dtype=np.int32)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                node = self.following[np.minimum(node, self.inner), chars[:, end - 1]]
                s = self.node_score[node]
                if np.isneginf(s).all():
                    if (node == self.dead).all():
                        break
                    continue
                ending[end].append((start, s, self.node_id[node]))
                np.maximum(forward[end], forward[start] + s, out=forward[end])
        here, done = np.full(rows, size), np.zeros(rows)
        second = np.full(rows, -np.inf)
        piece = np.zeros((size + 1, rows), dtype=np.uint32)
        on_path = np.zeros((size + 1, rows), dtype=bool)
        for end in range(size, 0, -1):
            live = np.flatnonzero(here == end)
            if not len(live):
                continue
            scores = np.stack([s[live] for _, s, _ in ending[end]])
            total = scores + np.stack([forward[start, live] for start, _, _ in ending[end]]) + done[live]
            best, every = total.argmax(axis=0), np.arange(len(live))  # of equal ones the earliest start
            done[live] += scores[best, every]
            here[live] = np.array([start for start, _, _ in ending[end]])[best]
            piece[end, live] = np.stack([i[live] for _, _, i in ending[end]])[best, every]
            on_path[end, live] = True
            total[best, every] = -np.inf
            second[live] = np.maximum(second[live], total.max(axis=0))
        raw = piece.T[on_path.T].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(on_path.sum(axis=0))).tolist()]
        for k, part in enumerate(parts):
            self.remember(part, raw[cuts[k] : cuts[k + 1]], done[k], done[k] - second[k])

    def parts(self, text: str) -> list[str]:
        if MARK in text:
            text = text.replace(MARK, OWN_MARK)
        return self.split.findall((" " + text).replace(" ", MARK)) if text else []

    def encode_many(self, texts, n: int = 1):
        """encode() of each text in turn; parts that several texts lack are solved together."""
        for start, stop in slices([len(t or "") for t in texts]):
            cut = [self.parts(t or "") for t in texts[start:stop]]
            if len(self.ids) > CACHE or self.held > CACHE_BYTES:
                self.forget()
            self.solve_many(sorted(set().union(*cut).difference(self.place)))
            for parts in cut:
                yield self._encode(parts, n)

    def encode(self, text: str | None, n: int = 1) -> list[tuple[float, bytes]]:
        """The n best (score, ids as little-endian 32-bit) of a text; null and empty have one of no ids."""
        return next(self.encode_many([text], n))

    def _encode(self, parts: list[str], n: int) -> list[tuple[float, bytes]]:
        places = list(map(self.place.__getitem__, parts))
        chosen = list(map(self.ids.__getitem__, places))
        best = (float(self.scores[places].sum()) if places else 0.0, b"".join(chosen))
        if n == 1 or not parts:
            return [best]
        # Only the n - 1 parts whose second best costs least can differ in the n best.
        loss = self.losses[places]
        least = np.arange(len(loss)) if len(loss) < n else np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2])
        least = least[np.argsort(loss[least], kind="stable")][: n - 1]
        open_parts = sorted(int(i) for i in least if loss[i] < np.inf)
        lists = []
        for i in open_parts:
            found, _ = self.search(parts[i], n)
            lists.append([(found[0][0], chosen[i]), *[x for x in found if x[1] != chosen[i]]][:n])
        heap = [(0.0, (0,) * len(lists))]
        seen, out = set(heap), []
        while heap and len(out) < n:
            cost, pick = heapq.heappop(heap)
            ids, last = [], 0
            for place, choice, options in zip(open_parts, pick, lists):
                ids += [*chosen[last:place], options[choice][1]]
                last = place + 1
            out.append((best[0] - cost, b"".join(ids + chosen[last:])))
            for k, options in enumerate(lists):
                if pick[k] + 1 < len(options):
                    step = (cost + options[pick[k]][0] - options[pick[k] + 1][0], pick[:k] + (pick[k] + 1,) + pick[k + 1 :])
                    if step not in seen:
                        seen.add(step)
                        heapq.heappush(heap, step)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, exactly as it was encoded."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw[1:].decode("utf-8", "surrogatepass")


def _mapped(docs: DataFrame, model: str, schema: str | T.StructType, make) -> DataFrame:
    """``make(vocabulary, slice of a batch, its texts)`` -> columns, for the column text of docs, in slices.

    So a worker holds the ids of a slice at a time, and never those of a whole batch.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                columns = make(shared.value, part, texts)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str = MODEL, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, score, ids) of the n best segmentations of every whole text; ids are little-endian 32-bit.

    The vocabulary is read on the driver from the path ``model`` and sent to
    the executors.  Null and empty texts have one segmentation of no ids; texts
    with fewer than n segmentations have all; ties have a fixed order.
    Repeated rows are encoded each; an empty table gives an empty result.
    """

    def make(v, part, texts):
        import pyarrow as pa

        best = [[{"score": s, "ids": i} for s, i in found] for found in v.encode_many(texts, n)]
        return {"id": part.column("id"), "best": pa.array(best, pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())])))}

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([picked.schema["id"], T.StructField("best", T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.BinaryType())])))])
    best = _mapped(picked, model, schema, make)
    return best.select("id", F.posexplode("best").alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), "x.score", "x.ids")


def decode(coded: DataFrame, model: str = MODEL, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give null, no ids an empty text, an empty table an empty result."""
    shared = coded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else shared.value.decode(bytes(i)) for i in ids], dtype=object)

    return coded.select(F.col(id_col).alias("id"), run(F.col(ids_col)).alias("text"))


def encoded_digests(docs: DataFrame, model: str = MODEL, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text: (doc_id, n_pieces, ids_sha256, scores, nbest_sha256, text_sha256).

    Digests of the best ids and of all n id lists, their scores, and the
    digest of the text as decoded from the best ids.  Null counts as empty, and
    repeated rows have a row each.
    """

    def make(v, part, texts):
        import pyarrow as pa

        out = []
        for best in v.encode_many(texts, n):
            ids = best[0][1]
            every = hashlib.sha256()
            for _, more in best:
                every.update(hashlib.sha256(more).digest())
            out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), [s for s, _ in best], every.hexdigest(), hashlib.sha256(v.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()))
        kinds = {"n_pieces": pa.int64(), "ids_sha256": pa.string(), "scores": pa.list_(pa.float64()), "nbest_sha256": pa.string(), "text_sha256": pa.string()}
        return {"doc_id": part.column("doc_id")} | {name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), zip(*out))}

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _mapped(picked, model, "doc_id long, n_pieces long, ids_sha256 string, scores array<double>, nbest_sha256 string, text_sha256 string", make)


def with_ids(docs: DataFrame, model: str = MODEL, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of the best segmentation (array of int) in place of the text, and ``exact``.

    ``exact`` says whether the ids decode to exactly the text.  Null and empty
    texts have no ids and are exact; repeated rows are encoded each; an empty
    table gives an empty result.  Columns of docs that are named like the two
    new ones give way to them; all others stay.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text_col, into, "exact")]

    def make(v, part, texts):
        import pyarrow as pa

        ids = [best[0][1] for best in v.encode_many(texts)]
        exact = pa.array([v.decode(i) == (t or "") for t, i in zip(texts, ids)], pa.bool_())
        ends = np.cumsum([0] + [len(i) // 4 for i in ids]).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
        return {f"c{i}": part.column(f"c{i}") for i in range(len(kept))} | {"ids": column, "exact": exact}

    picked = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    return _mapped(picked, model, schema, make).toDF(*[f.name for f in kept], into, "exact")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


def brute_force(vocabulary: Vocabulary, text: str) -> list[tuple[float, tuple[int, ...]]]:
    """All segmentations of a text without cutting it into parts, best first (for tests on short texts)."""
    whole = (" " + text.replace(MARK, OWN_MARK)).replace(" ", MARK) if text else ""

    def paths(at):
        if at == len(whole):
            yield 0.0, ()
            return
        for end, s, ids in vocabulary.edges(whole, at):
            for t, more in paths(end):
                yield s + t, ids + more

    return sorted(paths(0), key=lambda x: (-x[0], x[1]))

