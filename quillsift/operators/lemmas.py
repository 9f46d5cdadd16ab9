"""Lemmas by learned suffix edits.

Pairs of a form and its lemma become edit scripts: so many characters cut off at
the end, a string added.  Every suffix of the forms counts its scripts, and the
most frequent one is the suffix's decision; the decisions make a trie that is
read from a word's end, and the longest suffix that it knows decides.  Irregular
forms, and the learned pairs that their suffixes decide otherwise, are in a
dictionary of whole words.

``lemma_table`` applies both to a table of words by joins, inside the JVM;
``lemmatizer`` makes a plug-in for ``text.sentences`` and ``index.build`` that
walks the trie.  They agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, small_side
from .text import padded

#: Longest suffix of a decision, and forms that a decision needs.
LONGEST, LEAST = 7, 2
#: Words that a worker remembers.
REMEMBERED = 100_000

# Words from which regular forms are made by ``regular_pairs``.
VERBS = "add ask bake beg believe call carry change chat clap close cry decide die drop fill fix follow grab help hop hope hug hurry include invite like live love make miss jog move name need open pass place plan play plug push rain raise reach rob save ship show start stay stop study talk try turn use walk want wash watch work worry write".split()
NOUNS = "baby bed boss box bus car church city class cow dish dog fly game glass house key king lady lens name page party place ring sea spring string thing toy tree water wish wing word".split()
ADJECTIVES = "big brave busy clean cold dark deep easy fine happy hard hot large late long new nice old pretty sad short smug snug strong thin tidy warm wide young".split()
UNCHANGED = "always and axis basis bring crisis during easter for her his is it less less need never of one other over seed speed sing the this thus under us very was yes".split()
#: Irregular forms, by lemma.
IRREGULAR = {
    "be": "am are is was were been being", "have": "has had having", "do": "does did done doing", "go": "goes went gone going", "say": "said", "see": "saw seen", "take": "took taken", "give": "gave given", "find": "found",
    "think": "thought", "know": "knew known", "come": "came", "get": "got gotten getting", "make": "made", "write": "wrote written", "begin": "began begun beginning", "run": "ran running", "child": "children", "man": "men",
    "woman": "women", "foot": "feet", "tooth": "teeth", "mouse": "mice", "goose": "geese", "person": "people", "good": "better best", "bad": "worse worst", "far": "farther farthest", "life": "lives", "leaf": "leaves", "knife": "knives", "datum": "data", "analysis": "analyses",
}


def _doubled(word: str) -> bool:
    """A final consonant after one short vowel, as in stop, plan, big."""
    return len(word) <= 4 and len(word) >= 3 and word[-1] not in "aeiouwxy" and word[-2] in "aeiou" and word[-3] not in "aeiou"


def _stem(word: str, ending: str) -> str:
    if word.endswith("ie") and ending == "ing":
        return word[:-2] + "ying"
    if word.endswith("e"):
        return word[:-1] + ending if not (ending == "ing" and word.endswith(("ee", "ye", "oe"))) else word + ending
    if word.endswith("y") and word[-2] not in "aeiou" and ending != "ing":
        return word[:-1] + "i" + ending
    return word + (word[-1] if _doubled(word) else "") + ending


def _s(word: str) -> str:
    if word.endswith("y") and word[-2] not in "aeiou":
        return word[:-1] + "ies"
    return word + ("es" if word.endswith(("s", "x", "z", "ch", "sh", "o")) else "s")


def regular_pairs() -> list[tuple[str, str]]:
    """(form, lemma) of the regular forms of the words above, and the words as their own lemmas."""
    out = [(w, w) for w in (*VERBS, *NOUNS, *ADJECTIVES, *UNCHANGED)]
    out += [(f, w) for w in VERBS for f in (_s(w), _stem(w, "ed"), _stem(w, "ing"))]
    out += [(_s(w), w) for w in NOUNS]
    out += [(f, w) for w in ADJECTIVES for f in (_stem(w, "er"), _stem(w, "est"))]
    return sorted(set(out))


def irregular_pairs() -> list[tuple[str, str]]:
    return sorted((f, lemma) for lemma, forms in IRREGULAR.items() for f in forms.split())


def learn(pairs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """pairs(form, lemma) -> (suffix, cut, add): each suffix's most frequent script, ties to the shorter cut and then by ``add``.

    Equal pairs count once.  Suffixes that fewer than ``least`` forms share decide nothing.
    """
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("form"), F.length("lemma")))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring("form", F.lit(1), i) == F.substring("lemma", F.lit(1), i)), i).otherwise(n))
    scripts = pairs.where("length(form) > 0 AND length(lemma) > 0").distinct().withColumn("p", shared)
    scripts = scripts.select("form", (F.length("form") - F.col("p")).alias("cut"), F.expr("substring(lemma, p + 1, length(lemma))").alias("add"))
    lengths = F.expr(f"filter(sequence(1, {longest}), n -> n >= cut AND n < length(form))")
    each = scripts.select("cut", "add", "form", F.explode(lengths).alias("n")).select(F.expr("right(form, n)").alias("suffix"), "cut", "add")
    counts = each.groupBy("suffix", "cut", "add").agg(F.count("*").alias("n"))
    best = counts.groupBy("suffix").agg(F.sum("n").alias("forms"), F.min(F.struct((-F.col("n")).alias("n"), "cut", "add")).alias("x"))
    return best.where(F.col("forms") >= least).select("suffix", "x.cut", "x.add")


@dataclass
class Edits:
    """Suffix decisions and whole words; a value for workers, so it holds no table."""

    scripts: dict[str, tuple[int, str]]
    words: dict[str, str]
    trie: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        for suffix, script in self.scripts.items():
            node = self.trie
            for c in reversed(suffix):
                node = node.setdefault(c, {})
            node[""] = script

    def lemma(self, word: str) -> str:
        """The lemma of a lower-case word; a word that would be left with less than two characters stays."""
        if word in self.words:
            return self.words[word]
        node, script = self.trie, (0, "")
        for c in reversed(word):
            node = node.get(c)
            if node is None:
                break
            script = node.get("", script)
        cut, add = script
        return word if len(word) - cut < 2 else word[: len(word) - cut] + add


#: Decisions and words that are given to workers as a value.
MOST = 200_000


def collected(scripts: DataFrame, words: DataFrame) -> Edits:
    """Both tables as a value, which must have at most MOST rows each (more raise)."""
    held = [t.limit(MOST + 1).collect() for t in (scripts, words)]
    if max(map(len, held)) > MOST:
        raise ValueError(f"a lemmatizer takes at most {MOST} decisions and words; use lemma_table")
    return Edits({r["suffix"]: (r["cut"], r["add"]) for r in held[0]}, {r["form"]: r["lemma"] for r in held[1]})


def fit(pairs: DataFrame, irregular: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scripts, exceptions): both tables of (form, lemma) hold afterwards, the irregular ones first, of several lemmas the first."""
    scripts = materialize(learn(pairs), "suffix-edits")
    first = pairs.groupBy("form").agg(F.min("lemma").alias("lemma"))
    decided = lemma_table(first.select(F.col("form").alias("word")), scripts, irregular.limit(0)).withColumnRenamed("lemma", "decided")
    wrong = first.join(decided, F.col("form") == F.col("word")).where("lemma <> decided").select("form", "lemma")
    rest = wrong.join(irregular.select("form"), "form", "left_anti")
    return scripts, materialize(irregular.groupBy("form").agg(F.min("lemma").alias("lemma")).unionByName(rest), "exceptions")


def default_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``fit`` of the words above."""
    return fit(*(spark.createDataFrame(p, "form string, lemma string") for p in (regular_pairs(), irregular_pairs())))


def lemma_table(words: DataFrame, scripts: DataFrame, exceptions: DataFrame, longest: int = LONGEST) -> DataFrame:
    """words(word) -> (word, lemma), distinct.  Sides are broadcast after a count."""
    distinct = materialize(words.select("word").distinct(), "words")
    lower = distinct.select("word", F.lower("word").alias("form"))
    tails = lower.select("word", "form", F.explode(F.expr(f"transform(sequence(1, greatest(1, least({longest}, length(form)))), n -> right(form, n))")).alias("suffix"))
    found = tails.join(small_side(scripts), "suffix").groupBy("word").agg(F.max(F.struct(F.length("suffix").alias("n"), "cut", "add")).alias("x"))
    cut = F.when(F.length("form") - F.col("x.cut") >= 2, F.expr("concat(left(form, length(form) - x.cut), x.add)"))
    both = lower.join(found, "word", "left").join(small_side(exceptions.select("form", F.col("lemma").alias("irregular"))), "form", "left")
    return both.select("word", F.coalesce("irregular", cut, "form").alias("lemma"))


def lemmatizer(edits: Edits):
    """A plug-in of texts: tokens of the padded text, lower-cased and lemmatised, joined by single spaces; nulls stay null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def of(word: str) -> str:
            out = known.get(word)
            if out is None:
                out = edits.lemma(word)
                if len(known) < REMEMBERED:
                    known[word] = out
            return out

        return pd.Series([None if t is None else " ".join(map(of, t.split(" "))) for t in texts], dtype=object)

    def apply(text: Column) -> Column:
        return run(F.lower(padded(text)))

    return apply
