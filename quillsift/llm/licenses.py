"""License scans by template-markup matching.

A template is the wording of a license or notice with two kinds of markup:

* ``<<beginOptional>> ... <<endOptional>>``: may be left out as a whole, nested or not;
* ``<<var;name=n;match=a b|c>>``: replaceable by one of the phrases;
* ``<<var;name=n;words=0-12>>``: replaceable by so many words, whatever they are.

All else is mandatory and has to stand word by word (lower case, ASCII marks and
spaces apart).  Templates are compiled into one automaton over word numbers,
whose states become deterministic as texts need them.  It starts at words that
a template can start with and stops as soon as no template is left, so a text is
read once; what may follow a start is bounded by the longest template.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, text_slices


class Template(NamedTuple):
    label: str
    markup: str
    base: bool = False


# The phrases of the contract.
BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

UNDER = "<<var;name=verb;match=licensed|released|distributed|available|provided|published>> under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>>"
VERSION = "<<beginOptional>>version<<endOptional>>"
LATER = "<<var;name=later;match=or at your option any later version|or any later version|or later>>"
ITEM = "<<var;name=number;words=0-1>>"
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall
be included in all copies or substantial portions of the Software. <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL <<var;name=holder;words=1-20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<endOptional>>"""
BSD_TWO = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: {ITEM} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {ITEM}
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
BSD_THREE = f"""{BSD_TWO} {ITEM} Neither the name of <<var;name=holder;words=1-20>> nor the names of <<var;name=contributors;words=1-4>> may be used
to endorse or promote products derived from this software without specific prior written permission."""
ISC_GRANT = """Permission to use, copy, modify, <<var;name=and;match=and|and or|or>> distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
APACHE_FILE = """<<beginOptional>>(the "License"); you may not use this file except in compliance with the License<<endOptional>>"""


def _templates() -> tuple[Template, ...]:
    out = [
        Template("mit", MIT_GRANT),
        Template("mit", f"{UNDER} MIT License"),
        Template("bsd-2-clause", BSD_TWO),
        Template("bsd-3-clause", BSD_THREE),
        Template("isc", ISC_GRANT),
        Template("isc", f"{UNDER} ISC License"),
        Template("apache-2.0", f"{UNDER} Apache License, {VERSION} 2.0 {APACHE_FILE}"),
        Template("unlicense", "This is free and unencumbered software released into the public domain."),
        Template("cc0-1.0", f"{UNDER} <<var;name=cc0;match=cc0|creative commons zero|creative commons cc0>> {VERSION} <<beginOptional>>1.0<<endOptional>> <<beginOptional>>universal<<endOptional>>"),
    ]
    for label, name, versions in (("gpl", "GNU General Public License", ("2", "3")), ("lgpl", "GNU Lesser General Public License", ("2.1", "3")), ("agpl", "GNU Affero General Public License", ("3",))):
        for v in versions:
            spdx = f"{label}-{v}" if "." in v else f"{label}-{v}.0"
            out.append(Template(spdx, f"{UNDER} {name}, {VERSION} <<var;name=version;match={v}|v{v}|{v}.0>>"))
            header = f"under the terms of the {name} as published by the Free Software Foundation<<beginOptional>>;<<endOptional>> <<beginOptional>>either<<endOptional>> version {v} of the License"
            out += [Template(spdx, header), Template(f"{spdx}-or-later", f"{header}, {LATER}"), Template(f"{spdx}-or-later", f"{UNDER} {name}, {VERSION} {v} {LATER}")]
    kinds = {"by": "Attribution", "by-sa": "Attribution ShareAlike", "by-nc": "Attribution NonCommercial", "by-nd": "Attribution NoDerivatives", "by-nc-sa": "Attribution NonCommercial ShareAlike", "by-nc-nd": "Attribution NonCommercial NoDerivatives"}
    for kind, long in kinds.items():
        for v in ("2.0", "2.5", "3.0", "4.0"):
            out.append(Template(f"cc-{kind}-{v}", f"<<var;name=name;match=cc {kind}|creative commons {long}>> {VERSION} {v}"))
    spoken = sorted({t.label for t in out})
    return (*BASE, *out, *(Template(label, f"SPDX-License-Identifier: {label}") for label in spoken))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARK = re.compile(r"<<(.*?)>>", re.S)
#: Deterministic states that a worker remembers before it starts afresh.
STATES = 50_000
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 20

_SYMBOLS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def parse(markup: str) -> list:
    """Nodes ("word", w), ("optional", nodes), ("phrases", lists of words), ("any", least, most)."""
    stack: list[list] = [[]]
    for i, piece in enumerate(MARK.split(markup)):
        if i % 2 == 0:
            stack[-1] += [("word", w) for w in words_of(piece)]
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1] += [("optional", inner)] if inner else []
        else:
            fields = dict(f.split("=", 1) for f in piece.split(";")[1:])
            if "match" in fields:
                stack[-1].append(("phrases", [words_of(p) for p in fields["match"].split("|")]))
            elif "words" in fields:
                stack[-1].append(("any", *map(int, fields["words"].split("-"))))
            else:
                raise ValueError(f"markup <<{piece}>> has neither match nor words")
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def least_words(nodes: list) -> int:
    """Words of the shortest accepted wording."""
    of = {"word": lambda n: 1, "optional": lambda n: 0, "phrases": lambda n: min(map(len, n[1])), "any": lambda n: n[1]}
    return sum(of[n[0]](n) for n in nodes)


class Automaton:
    """All templates over word numbers; 0 is any word that no template has."""

    def __init__(self, templates: tuple[Template, ...]):
        self.numbers: dict[bytes, int] = {}
        self.by_word: list[dict[int, list[int]]] = [{}]
        self.by_any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        self.accepts: dict[int, int] = {}
        for t, template in enumerate(templates):
            nodes = parse(template.markup)
            if not least_words(nodes):
                raise ValueError(f"template {template.label} has no mandatory word")
            self.accepts[self._add(0, nodes)] = t
        self._reset()
        if self.by_any_of(self.start):
            raise ValueError("a template starts with any word")
        self.starts = np.zeros(len(self.numbers) + 1, bool)
        self.starts[[w for n in self.start for w in self.by_word[n]]] = True

    def _node(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def _read(self, at: int, words: list[str]) -> int:
        for w in words:
            to = self._node()
            self.by_word[at].setdefault(self.numbers.setdefault(w.encode(), len(self.numbers) + 1), []).append(to)
            at = to
        return at

    def _add(self, at: int, nodes: list) -> int:
        """The node after ``nodes``, which start at ``at``."""
        for node in nodes:
            if node[0] == "word":
                at = self._read(at, [node[1]])
            elif node[0] == "optional":
                end = self._add(at, node[1])
                out = self._node()
                self.free[at].append(out)
                self.free[end].append(out)
                at = out
            elif node[0] == "phrases":
                out = self._node()
                for words in node[1]:
                    self.free[self._read(at, words)].append(out)
                at = out
            else:
                out = self._node()
                for i in range(node[2] + 1):
                    if i >= node[1]:
                        self.free[at].append(out)
                    if i < node[2]:
                        to = self._node()
                        self.by_any[at].append(to)
                        at = to
                at = out
        return at

    def _closed(self, nodes) -> frozenset[int]:
        seen, open_ = set(nodes), list(nodes)
        while open_:
            for to in self.free[open_.pop()]:
                if to not in seen:
                    seen.add(to)
                    open_.append(to)
        return frozenset(seen)

    def _reset(self) -> None:
        self.start = self._closed([0])
        self.known: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.found: list[tuple[int, ...]] = []
        self.steps: list[dict[int, int]] = []
        self._state(self.start)

    def _state(self, nodes: frozenset[int]) -> int:
        """The number of a set of nodes; -1 for none."""
        if not nodes:
            return -1
        if nodes not in self.known:
            self.known[nodes] = len(self.sets)
            self.sets.append(nodes)
            self.found.append(tuple(sorted(self.accepts[n] for n in nodes if n in self.accepts)))
            self.steps.append({})
        return self.known[nodes]

    def by_any_of(self, nodes) -> list[int]:
        return [to for n in nodes for to in self.by_any[n]]

    def step(self, state: int, word: int) -> int:
        to = self.steps[state].get(word)
        if to is None:
            nodes = self.sets[state]
            to = self._state(self._closed([m for n in nodes for m in self.by_word[n].get(word, ())] + self.by_any_of(nodes)))
            self.steps[state][word] = to
        return to

    def words(self, text: str) -> np.ndarray:
        """The numbers of a text's words; the text goes through in chunks that end between words."""
        raw, get, out, at = text.encode().translate(_SYMBOLS), self.numbers.get, [], 0
        while at < len(raw):
            end = raw.find(b" ", at + CHUNK)
            end = len(raw) if end < 0 else end
            out.append(np.fromiter(map(get, raw[at:end].split(), repeat(0)), np.int32))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def matches(self, words: np.ndarray, single: list[bool]) -> list[tuple[int, int, int]]:
        """(template, start, stop) in words, the longest from each start; ``single`` templates are reported once where they overlap themselves."""
        if len(self.sets) > STATES:
            self._reset()
        out, upto = [], {}
        for start in np.flatnonzero(self.starts[words]).tolist():
            state, i, best = 0, start, {}
            while i < len(words) and (state := self.step(state, int(words[i]))) >= 0:
                i += 1
                for t in self.found[state]:
                    best[t] = i
            for t, stop in sorted(best.items()):
                if not single[t] or start >= upto.get(t, 0):
                    out.append((t, start, stop))
                    upto[t] = stop
        return out


@lru_cache(maxsize=4)
def compiled(templates: tuple[Template, ...]) -> Automaton:
    return Automaton(templates)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] | None = None) -> DataFrame:
    """(doc_id, n_words, matches) for every row.

    ``matches`` is an array of (label, base, wording, start, stop): a template's
    label, whether it is a base phrase, the words of its shortest wording, and
    the place in words.  Base phrases are reported at every place.  A null text
    counts as empty and has no match; repeated rows give a row each; an empty
    table gives an empty result.  Columns other than the two named are not read.
    """
    small_batches(docs.sparkSession)
    chosen = tuple(templates if templates is not None else TEMPLATES)
    compiled(chosen)  # markup that cannot be read raises here
    kind = "struct<label: string, base: boolean, wording: int, start: long, stop: long>"

    def run(batches):
        import pyarrow as pa

        automaton, single = compiled(chosen), [not t.base for t in chosen]
        wording = [least_words(parse(t.markup)) for t in chosen]
        fields = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("wording", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                n, found = [], []
                for text in texts:
                    words = automaton.words(text or "")
                    n.append(len(words))
                    found.append([{"label": chosen[t].label, "base": chosen[t].base, "wording": wording[t], "start": a, "stop": b} for t, a, b in automaton.matches(words, single)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, fields)], names=["doc_id", "n_words", "matches"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_words long, matches array<{kind}>")


TEMPLATES = _templates()
#: Words of evidence that count half.
HALF = 4


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    """The score is w / (w + HALF), w being the words of the longest wording that was found."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    most = F.coalesce(F.array_max(F.transform("matches", lambda m: m["wording"])), F.lit(0)).cast("double")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), (most / (most + HALF)).alias("score"),
    )


def _pattern(nodes: list) -> str:
    """A regular expression over words that each have a space behind them."""
    of = {
        "word": lambda n: n[1] + " ",
        "optional": lambda n: f"(?:{_pattern(n[1])})?",
        "phrases": lambda n: "(?:" + "|".join("".join(w + " " for w in p) for p in n[1]) + ")",
        "any": lambda n: f"(?:[^ ]+ ){{{n[1]},{n[2]}}}",
    }
    return "".join(of[n[0]](n) for n in nodes)


def _sql() -> str:
    rows = ", ".join(f"('{t.label}', {least_words(parse(t.markup))}, ' {_pattern(parse(t.markup))}')" for t in TEMPLATES if not t.base)
    lists = ", ".join(f"('{t.label}', {words_of(t.markup)})" for t in BASE)
    return rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_no, label, len(p) AS k, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = p[1] AND w[i:i + len(p) - 1] = p)) - 1 AS place FROM w, (VALUES {lists}) v(label, p)),
j AS (SELECT row_no, ' ' || array_to_string(w, ' ') || ' ' AS s FROM w),
m AS (SELECT DISTINCT row_no, label, k FROM j, (VALUES {rows}) v(label, k, p) WHERE regexp_matches(s, p)),
n AS (SELECT row_no, count(*) AS n, min(place) AS a, max(place) AS z, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM b GROUP BY row_no),
a AS (SELECT row_no, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(k)::DOUBLE AS k FROM (SELECT row_no, label, k FROM b UNION ALL SELECT * FROM m) GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, n.a::BIGINT AS first_word, n.z::BIGINT AS last_word,
       coalesce(n.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.k, 0) / (coalesce(a.k, 0) + {HALF}) AS score
FROM w LEFT JOIN n USING (row_no) LEFT JOIN a USING (row_no)
"""


OP12_SQL = _sql()
