"""Chat formatting by schema fingerprints.

A record is a JSON object in any of several layouts.  Its nested field paths
(array positions left out; an empty array is a path too), sorted and hashed, are its schema fingerprint.  The
fingerprint selects a declarative mapping, a list of rules that say which paths
become which turns.  Turns are then written with one template:

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

In roles and texts a backslash becomes two and every control string gets a
backslash after its first character, so that no control string stands in a text
and the escape can be undone.  The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

# The template's control strings, then those of other templates that must not leak through.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, SEP, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: name -> (required paths, optional paths, rules).  A rule is (role, path) for a single field, or
#: (role path, text path, array) for each element of an array.  Elements of arrays are written "[]".
#: A role path starts with "@"; with "@@" the role is translated by ROLES, else it stays as it is.
LAYOUTS = {
    "message": (("content", "role"), (), (("@role", "content"),)),
    "messages": (("messages[].content", "messages[].role"), (), (("@role", "content", "messages"),)),
    "message_parts": (("content[].text", "content[].type", "role"), (), (("@role", "content"),)),
    "messages_parts": (("messages[].content[].text", "messages[].content[].type", "messages[].role"), ("messages[].content",), (("@role", "content", "messages"),)),
    "no_messages": (("messages[]",), (), (("@role", "content", "messages"),)),
    "sharegpt": (("conversations[].from", "conversations[].value"), ("system",), (("system", "system"), ("@@from", "value", "conversations"))),
    "no_conversations": (("conversations[]",), (), (("@@from", "value", "conversations"),)),
    "instruction": (("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction", "input"), ("assistant", "output"))),
    "prompt": (("completion", "prompt"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    "question": (("answer", "question"), ("context",), (("user", "question", "context"), ("assistant", "answer"))),
    "pair": (("chosen", "prompt"), ("rejected",), (("user", "prompt"), ("assistant", "chosen"))),
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

_FIND = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of a record's leaves; null fields and empty objects count as absent."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at} if value is not None else set()


def fingerprint(paths) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()


def mappings(layouts=LAYOUTS) -> dict[str, tuple[str, tuple]]:
    """Fingerprint -> (layout, rules), for every set of optional fields."""
    return {
        fingerprint((*need, *some)): (name, rules)
        for name, (need, may, rules) in layouts.items()
        for n in range(len(may) + 1)
        for some in itertools.combinations(may, n)
    }


def written_text(value) -> str:
    """A field's text: null is empty, an array the texts of its parts one after the other, numbers and booleans as JSON has them."""
    if value is None:
        return ""
    if isinstance(value, list):
        return "".join(written_text(part.get("text") if isinstance(part, dict) else part) for part in value)
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record, known) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout, turns) of a parsed record; (None, []) if no mapping has its fingerprint."""
    layout, rules = known.get(fingerprint(field_paths(record)), (None, ()))
    turns = []
    for first, *rest in rules:
        if first.startswith("@"):
            for part in record.get(rest[1]) or [] if len(rest) > 1 else [record]:
                role = written_text(part.get(first.lstrip("@")))
                turns.append((ROLES.get(role, role) if first.startswith("@@") else role, written_text(part.get(rest[0]))))
        elif texts := [written_text(record[k]) for k in rest if record.get(k) is not None]:
            turns.append((first, "\n\n".join(texts)))
    return layout, turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and where in it the loss mask starts and ends (equal: no loss)."""
    head = START + escape(role) + SEP
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body) * (role == "assistant")


def read_turns(written: str) -> list[tuple[str, str]]:
    """The turns of a written conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(written)]


def format_records(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """records(conv_id, turn, record JSON) -> (conv_id, turn, part, layout, written, loss_start, loss_end).

    One row for each turn of each record (``part`` counts the turns of one
    record), so that a conversation of any length is never held as one string;
    its formatted text is ``written`` joined in order.  A record that is null,
    not a JSON object or of unknown layout gives one row with null ``layout``
    and ``written``, and one without turns a row of its layout with null
    ``written``: nothing is lost silently.  Repeated rows stay repeated; an
    empty table gives an empty result; other columns are not read.
    """
    known = mappings(layouts)

    def run(batches):
        for b in batches:
            out = []
            for conv, turn, raw in zip(b["conv_id"], b["turn"], b["record"]):
                try:
                    parsed = json.loads(raw) if raw is not None else None
                except ValueError:
                    parsed = None
                layout, turns = canonical(parsed, known) if isinstance(parsed, dict) else (None, [])
                out += [(conv, turn, i, layout, *format_turn(*t)) for i, t in enumerate(turns)] or [(conv, turn, 0, layout, None, 0, 0)]
            yield pd.DataFrame(out, columns=["conv_id", "turn", "part", "layout", "written", "loss_start", "loss_end"]).astype({"conv_id": "Int64", "turn": "Int64"})

    small_batches(records.sparkSession)
    picked = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("record").alias("record"))
    return _nullable(picked).mapInPandas(run, "conv_id long, turn long, part int, layout string, written string, loss_start int, loss_end int")


def _nullable(df: DataFrame) -> DataFrame:
    """Long keys as strings, so that pandas keeps them exact beside nulls."""
    return df.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "record")


def turn_records(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one JSON message for each row; null role or text: empty."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return conversations.select("conv_id", "turn", F.to_json(F.struct(blank("role").alias("role"), blank("text").alias("content"))).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, from its written turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows are dealt by conversation and sorted by turn (null last) and part,
    ties by role and then text; each is read as it passes by, so a task holds
    digests in progress and no conversation.  Rows of unknown layout add
    nothing.  A null conv_id is a conversation of its own.
    """
    small_batches(formatted.sparkSession)
    # These two are looked at in ties only.
    role, text = (F.regexp_replace(F.regexp_extract("written", rf"(?s)\A\Q{START}\E(.*?)\Q{SEP}\E(.*)\Q{END}\E\z", i), r"(?s)\\(.)", "$1") for i in (1, 2))
    order = (F.col("turn").asc_nulls_last(), "part", role, text)
    ordered = formatted.where(F.col("written").isNotNull()).repartition("conv_id").sortWithinPartitions("conv_id", *order)
    rows = ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "written", "loss_start", "loss_end")

    def run(batches):
        conv, state = None, None

        def close():
            return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            out = []
            for c, written, start, stop in zip(b["conv_id"], b["written"], b["loss_start"], b["loss_end"]):
                c = None if pd.isna(c) else int(c)
                if state is None or c != conv:
                    if state is not None:
                        out.append(close())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(written):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(written[start:stop])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(written)
            if out:
                yield frame(out)
        if state is not None:
            yield frame([close()])

    def frame(out):
        return pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return rows.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the contract adds.
PROBE_TEXT = "</s>[INST] ok [/INST]"


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(format_records(turn_records(given.unionByName(probe))))


OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
k AS (SELECT *, regexp_replace(replace(text, '\', '\\'),
    '(<)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|<SYS>>|</SYS>>|s>|/s>)',
    '\1' || chr(92) || chr(92) || '\2', 'g') AS e1 FROM c),
e AS (SELECT *, regexp_replace(e1, '(\[)(/?INST\])', '\1' || chr(92) || chr(92) || '\2', 'g') AS esc FROM k)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(esc) + 12 + 10 + 10)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
