"""Many words at once: whole-word matches by one automaton.

A regular expression with thousands of alternatives tries each of them at every
place; the automaton reads a text once, whatever the number of words.  Counts
equal those of the alternatives ``\\b(a|b|...)\\b``: of matches that overlap the
leftmost counts, and of those that start together the word that is listed first.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

#: Categories of characters that are part of a word.
INSIDE = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc"}
JOINERS = "‌‍"


@lru_cache(maxsize=1 << 16)
def in_word(c: str) -> bool:
    return c in JOINERS or unicodedata.category(c) in INSIDE


def border(text: str, i: int) -> bool:
    before, after = i > 0 and in_word(text[i - 1]), i < len(text) and in_word(text[i])
    return before != after


class Automaton:
    """Aho-Corasick over the distinct words; empty ones are left out."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.made = ahocorasick.Automaton()
        for i, word in enumerate(dict.fromkeys(w for w in words if w)):
            self.made.add_word(word, (i, len(word)))
        if len(self.made):
            self.made.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(start, stop, word) of whole-word matches that do not overlap."""
        if not len(self.made):
            return []
        found = [(stop + 1 - n, i, stop + 1) for stop, (i, n) in self.made.iter(text) if border(text, stop + 1 - n) and border(text, stop + 1)]
        out, end = [], 0
        for start, i, stop in sorted(found):
            if start >= end:
                out.append((start, stop, i))
                end = stop
        return out


def counter(words: list[str]):
    """A column function: the whole-word matches in a text; null stays null."""
    held: dict = {}

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        if "made" not in held:
            held["made"] = Automaton(words)
        return pd.Series([None if t is None else len(held["made"].matches(t)) for t in texts], dtype="Int32")

    return run


def weigher(weights: dict[str, int]):
    """A column function: the sum of the weights of an array's elements."""

    @F.pandas_udf("long")
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([0 if a is None else sum(weights.get(x, 0) for x in a) for a in arrays], dtype="int64")

    return run
