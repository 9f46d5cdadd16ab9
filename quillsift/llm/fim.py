"""Fill-in-middle transformation by an event scan.

Units are runs of ASCII letters, and every other character alone.  A text is
read as one symbol a code point: the characters that sentinels are made of stand
for themselves, all others for their class (letter or not).  One Aho-Corasick
automaton over these symbols reports the places where the class changes (its
patterns are the pairs of symbols of unlike class) and the sentinels.  Between
two changes the units follow by arithmetic: a gap of letters is one unit, any
other gap has a unit for each character.  So the running sums over the gaps, a
few for each word, are enough to count the units and to look up where the unit
of a given rank starts; no list of tokens is made.

Texts go through in chunks; what is held for a text besides itself is eight
bytes for each change of class.
"""

from __future__ import annotations

from functools import lru_cache
from string import ascii_letters

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Prefix, suffix and middle sentinel.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_SHARE, SPM_SHARE = 10, 20
SEED = 1
#: Symbols that the automaton reads at a time.
CHUNK = 1 << 20
CHANGE, SENTINEL = 1, 2

_CONTINUATION = bytes(range(0x80, 0xC0))


@lru_cache(maxsize=8)
def _scanner(sentinels: tuple[str, ...]):
    """(automaton, table of bytes to symbols, letters among the symbols, length of the longest pattern)."""
    import ahocorasick

    own = sorted(set("".join(sentinels)))
    letter = next(c for c in ascii_letters if c not in own)
    other = next(c for c in map(chr, range(32, 127)) if c not in own and c not in ascii_letters)
    symbols = bytes(ord(c) if c in own else ord(letter if c in ascii_letters else other) for c in map(chr, range(128))) + bytes([ord(other)]) * 128
    letters, others = [c for c in (*own, letter) if c in ascii_letters], [c for c in (*own, other) if c not in ascii_letters]
    patterns = dict.fromkeys([p for a in letters for b in others for p in (a + b, b + a)], CHANGE)
    for s in sentinels:
        patterns[s] = patterns.get(s, 0) | SENTINEL
    automaton = ahocorasick.Automaton()
    for pattern, what in patterns.items():
        automaton.add_word(pattern, what)
    automaton.make_automaton()
    return automaton, symbols, frozenset(letters), max(map(len, patterns))


def _events(text: str, sentinels: tuple[str, ...]) -> tuple[np.ndarray, bool, bool]:
    """(places where the class changes, whether the text starts with a letter, whether it has a sentinel)."""
    automaton, symbols, letters, longest = _scanner(sentinels)
    read = text.encode().translate(symbols, _CONTINUATION).decode("ascii")
    changes, found = [], False
    for start in range(0, len(read), CHUNK):
        begin = max(0, start - longest + 1)
        hits = [(at + begin, what) for at, what in automaton.iter(read[begin : start + CHUNK])]
        changes.append(np.fromiter((at for at, what in hits if what & CHANGE and at >= start), np.int64))
        found = found or any(what & SENTINEL for _, what in hits)
    return np.concatenate(changes or [np.zeros(0, np.int64)]), read[:1] in letters, found


class Units:
    """The number of a text's units, and the place in code points where the unit of a rank starts."""

    def __init__(self, text: str, sentinels: tuple[str, ...] = SENTINELS):
        changes, first, self.has_sentinel = _events(text, sentinels)
        self.starts = np.concatenate([[0], changes, [len(text)]])
        gaps = np.diff(self.starts)
        self.letters = (np.arange(len(gaps)) % 2 == 0) == first
        self.before = np.concatenate([[0], np.cumsum(np.where(self.letters, np.minimum(gaps, 1), gaps))])

    def __len__(self) -> int:
        return int(self.before[-1])

    def place(self, rank: int) -> int:
        """Where ``rank`` units from the start of the text end."""
        if rank >= len(self):
            return int(self.starts[-1])
        gap = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.starts[gap] + (0 if self.letters[gap] else rank - self.before[gap]))


def _group(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS, seed: int = SEED, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) for every row.

    ``n`` counts units; the text is cut at two ranks that hashes of the id
    choose.  ``form`` is plain (an empty text, one with a sentinel, or
    ``plain_share`` per cent of the rest), spm (``spm_share`` per cent of what
    remains) or psm.  A null text counts as empty, a null id as an empty one in
    the hash; repeated rows are cut alike; an empty table gives an empty result.
    Columns other than the two named are not read.
    """
    small_batches(docs.sparkSession)
    prefix, suffix, middle = (F.lit(s) for s in sentinels)

    @F.pandas_udf("n long, plain boolean, a long, b long")
    def cut(texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        out = []
        for text, x, y in zip(texts, h1, h2):
            units = Units(text, tuple(sentinels))
            ranks = sorted((int(x) % (len(units) + 1), int(y) % (len(units) + 1)))
            out.append((len(units), units.has_sentinel, *map(units.place, ranks)))
        return pd.DataFrame(out, columns=["n", "plain", "a", "b"])

    hashed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    found = hashed.withColumn("x", cut("text", _group(F.col("h"), 0), _group(F.col("h"), 1)))
    plain = (F.col("text") == "") | F.col("x.plain") | (_group(F.col("h"), 2) % 100 >= 100 - plain_share)
    form = F.when(plain, "plain").when(_group(F.col("h"), 3) % 100 < spm_share, "spm").otherwise("psm")
    a, b = F.col("x.a").cast("int"), F.col("x.b").cast("int")
    parts = found.withColumn("form", form).select(
        "doc_id", "text", F.col("x.n").alias("n"), "form", "x",
        F.substring("text", F.lit(1), a).alias("p"), F.substring("text", a + 1, b - a).alias("m"), F.substring("text", b + 1, F.length("text")).alias("s"),
    )
    output = F.when(F.col("form") == "psm", F.concat(prefix, "p", suffix, "s", middle, "m")).when(F.col("form") == "spm", F.concat(suffix, "s", prefix, "p", middle, "m")).otherwise(F.col("text"))
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return parts.select("doc_id", "text", "n", "form", cut_only(F.col("x.a")).alias("prefix_chars"), cut_only(F.col("x.b") - F.col("x.a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of ``transform`` was made of; texts in parts hold no sentinel, so each is found once."""
    prefix, suffix, middle = (F.lit(s) for s in sentinels)

    def between(first: Column, second: Column) -> tuple[Column, Column, Column]:
        rest = F.split_part(output, first, F.lit(2))
        return F.split_part(rest, second, F.lit(1)), F.split_part(F.split_part(output, second, F.lit(2)), middle, F.lit(1)), F.split_part(output, middle, F.lit(2))

    p, s, m = between(prefix, suffix)
    s2, p2, m2 = between(suffix, prefix)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
g AS (SELECT doc_id, text, w, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT doc_id, text, n, form, array_to_string(w[1:least(x, y)], '') AS p, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(w[greatest(x, y) + 1:], '') AS s FROM g)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM c
"""
