"""Plug-in points for models: a lemmatiser, a sentence validator and an embedder.

Each takes a plain function over a list of strings and gives an Arrow-batched
UDF, which ``text.sentences``, ``sources.index.build`` and ``topics.embed`` take
as parameters; the engine's defaults are SQL expressions and need none of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def text_plugin(function: Callable[[list[str]], list[str]]):
    """A lemmatiser: texts to texts; nulls stay null."""

    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        out[known] = function(texts[known].to_list())
        return out

    return F.pandas_udf(run, "string")


def validator_plugin(function: Callable[[list[str]], list[bool]]):
    """A sentence validator: texts to booleans; nulls are not valid."""

    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([False] * len(texts))
        out[known] = function(texts[known].to_list())
        return out

    return F.pandas_udf(run, "boolean")


def splitter_plugin(valid: Callable[[list[str]], list[bool]]):
    """A splitter of lemmatised texts into sentences by a validator of sentences.

    A piece that ends in . ! ? is a sentence if ``valid`` says so of what has
    gathered up to it, else it goes on into the next; a rest is a sentence if
    it is valid, else it joins the last one, and without one it is lost.
    """

    def split(text: str) -> list[str]:
        out, open_ = [], ""
        for piece in (p.strip() for p in re.findall(r"[^.!?]*[.!?]|[^.!?]+$", text)):
            open_ = f"{open_} {piece}" if open_ else piece
            if open_[-1:] in (".", "!", "?") and valid([open_])[0]:
                out.append(open_)
                open_ = ""
        if open_ and valid([open_])[0]:
            out.append(open_)
        elif open_ and out:
            out[-1] += " " + open_
        return out

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else split(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<string>")


def embedder_plugin(load: Callable[[], Callable[[list[str]], list]], batch: int = 16):
    """An embedder: ``load`` is called once for each task and gives texts to vectors, ``batch`` at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = texts.fillna("").to_list()
            yield pd.Series([list(map(float, v)) for at in range(0, len(rows), batch) for v in model(rows[at : at + batch])], dtype=object)

    return F.pandas_udf(run, "array<double>")
