"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

All of it is SQL expressions.  Positions count code points from 0, ends are
exclusive.  A span's kind is one of KINDS; the first three come from fixed
patterns (leftmost, non-overlapping for each kind), the last three from the
entropy method:

* candidates are runs of 20 or more characters of ``A-Za-z0-9+/_=-``;
* a window of WINDOW characters slides over a candidate.  Its character counts
  change by one in and one out at each step, and with them the sum
  S = sum of c * log2(c) over the counts c, so that the entropy is
  log2(WINDOW) - S / WINDOW.  The weights c * log2(c) are held as integers, so
  equal windows have exactly equal sums;
* the character class is the narrowest of hex, alphanumeric and base64 that
  holds the whole candidate, each with a limit of its own; a hot window also
  needs a digit and a letter;
* a run of hot windows that touch is one span;
* candidates that fit the allow-list (UUIDs, names joined by dashes, paths)
  are suppressed, and so are runs that hold a placeholder or an alphabet in
  order, and spans inside a pattern's span.

The work is in proportion to the length of a text.  A candidate is cut into
characters once and goes through in chunks; a step changes two of six packed
words of counts.  Spark copies an accumulator at every step, so accumulators
never grow beyond a block: running sums and maxima are taken in blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# The patterns of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy in bits of a window of each class.
ENTROPY = {"entropy_hex": 2.9, "entropy_alnum": 3.7, "entropy_base64": 3.8}
CLASSES = {"entropy_hex": r"^([0-9a-f]+|[0-9A-F]+)$", "entropy_alnum": r"^[A-Za-z0-9]+$", "entropy_base64": r"^[A-Za-z0-9+/_=-]+$"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SCALE = 1_000_000
#: Patterns of whole candidates, and of hot runs, that are no secrets.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?(?:[A-Za-z]++[0-9]{0,4}+[-_/=+])++[A-Za-z]*+[0-9]{0,4}$",  # possessive: Java would recurse at each segment
)
ALLOW_RUNS = (
    r"(?i)(example|placeholder|xxxxxx|changeme|dummy)",
    r"(?i)(0123456789|abcdefghijkl|1234567890)",
)
#: Elements of a running sum's block, and windows of a chunk of a candidate.
BLOCK, CHUNK = 64, 4096
#: Characters whose counts share a word, and bits of each count.
PACKED, BITS = 12, 5


def weight(count: int) -> int:
    """count * log2(count) as an integer."""
    return round(count * math.log2(count) * SCALE) if count else 0


def sum_limit(bits: float, window: int = WINDOW) -> int:
    """The largest S of a window whose entropy is ``bits`` or more."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _bound(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _before(values: str, op) -> str:
    """SQL: for each of an array of whole numbers from 0, the sum (or what ``op`` makes) of those before it, in blocks."""
    walk = lambda over, x: f"aggregate({over}, named_struct('at', 0, 'out', CAST(array() AS ARRAY<INT>)), (st, x) -> named_struct('at', {op('st.at', x)}, 'out', concat(st.out, array(st.at))))"
    part = f"IF(size(v) = 0, CAST(array() AS ARRAY<INT>), transform(sequence(b * {BLOCK}, least((b + 1) * {BLOCK}, size(v)) - 1), i -> v[CAST(i AS INT)]))"  # slice() would copy all of v
    blocks = f"transform(sequence(0, (size(v) - 1) DIV {BLOCK}), b -> {walk(part, 'x')})"
    return _bound(values, "v", _bound(blocks, "l", f"flatten(zip_with(l, {walk('l', 'x.at')}.out, (x, o) -> transform(x.out, y -> {op('o', 'y')})))"))


def _sum(a: str, b: str) -> str:
    return f"{a} + {b}"


def _largest(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _found(text: str, pattern: str) -> str:
    """SQL: array of (start, stop, match) of a pattern, which no text holds that fails the rlike."""
    quoted = _quoted(pattern)
    pairs = f"zip_with(split({text}, '{quoted}', -1), regexp_extract_all({text}, '{quoted}', 0), (g, m) -> named_struct('gap', length(g), 'len', length(m), 'match', m))"
    ends = _before("transform(z, x -> x.gap + coalesce(x.len, 0))", _sum)
    spans = f"filter(zip_with(z, {ends}, (x, at) -> named_struct('start', at + x.gap, 'stop', at + x.gap + x.len, 'match', x.match)), x -> x.match IS NOT NULL)"
    return f"CASE WHEN {text} RLIKE '{quoted}' THEN {_bound(pairs, 'z', spans)} ELSE CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT, match: STRING>>) END"


def _hot_runs(candidate: str) -> str:
    """SQL: array of (start, stop) inside a candidate where windows are hot."""
    weights = "array(" + ", ".join(f"{weight(c)}L" for c in range(WINDOW + 1)) + ")"
    most = "CASE " + " ".join(f"WHEN {candidate} RLIKE '{CLASSES[k]}' THEN {sum_limit(ENTROPY[k])}L" for k in ENTROPY) + " END"
    # By place in ALPHABET, from 1; 0 is no character.
    digit = lambda c: f"CAST({c} BETWEEN {ALPHABET.index('0') + 1} AND {ALPHABET.index('9') + 1} AS INT)"
    letter = lambda c: f"CAST({c} BETWEEN 1 AND {ALPHABET.index('z') + 1} AS INT)"
    w = lambda count: f"element_at({weights}, CAST({count} AS INT) + 1)"
    # Counts are packed: those of the characters at places 1 to PACKED are BITS bits each of the first word, and so on.
    word = lambda c: f"(({c} - 1) DIV {PACKED})"
    shift = lambda c: f"CAST({BITS} * (({c} - 1) % {PACKED}) AS INT)"
    count = lambda c: f"(shiftright(element_at(st.n, CAST({word(c)} AS INT) + 1), {shift(c)}) & {2**BITS - 1})"
    words = -(-len(ALPHABET) // PACKED)
    # A chunk has the windows that end at places b * CHUNK + 1 to (b + 1) * CHUNK; it starts WINDOW - 1 characters before.
    # One step: the character at place x of the alphabet enters, y leaves (0 while the first window fills).
    # u holds the counts and sums after it; hot windows extend the open run (rs, re) or start another.
    chunk = f"""aggregate(
      transform(sequence(greatest(0, CAST(b * {CHUNK} AS INT) - {WINDOW - 1}), least(CAST((b + 1) * {CHUNK} AS INT), size(k.c)) - 1), (i, j) -> named_struct(
        'i', i + 1, 'x', k.c[i], 'y', IF(j >= {WINDOW}, k.c[i - {WINDOW}], 0), 'full', j + 1 >= {WINDOW})),
      named_struct('n', array_repeat(0L, {words}), 's', 0L, 'd', 0, 'l', 0, 'rs', -1, 're', -1, 'out', CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT>>)),
      (st, c) -> transform(array(named_struct(
            'n', IF(c.x = c.y, st.n, transform(st.n, (v, j) -> v + IF(j = {word('c.x')}, shiftleft(1L, {shift('c.x')}), 0L) - IF(c.y > 0 AND j = {word('c.y')}, shiftleft(1L, {shift('c.y')}), 0L))),
            's', IF(c.x = c.y, st.s, st.s + {w(f"{count('c.x')} + 1")} - {w(count('c.x'))}
                 - IF(c.y = 0, 0L, {w(count('greatest(1, c.y)'))} - {w(f"greatest(0, {count('greatest(1, c.y)')} - 1)")})),
            'd', st.d + {digit('c.x')} - {digit('c.y')},
            'l', st.l + {letter('c.x')} - {letter('c.y')})),
          u -> CASE
            WHEN NOT (c.full AND u.s <= k.most AND u.d > 0 AND u.l > 0) THEN
              named_struct('n', u.n, 's', u.s, 'd', u.d, 'l', u.l, 'rs', st.rs, 're', st.re, 'out', st.out)
            WHEN st.re >= c.i - {WINDOW} THEN
              named_struct('n', u.n, 's', u.s, 'd', u.d, 'l', u.l, 'rs', st.rs, 're', c.i, 'out', st.out)
            ELSE named_struct('n', u.n, 's', u.s, 'd', u.d, 'l', u.l, 'rs', c.i - {WINDOW}, 're', c.i,
              'out', IF(st.re < 0, st.out, concat(st.out, array(named_struct('start', st.rs, 'stop', st.re))))) END)[0],
      st -> IF(st.re < 0, st.out, concat(st.out, array(named_struct('start', st.rs, 'stop', st.re)))))"""
    codes = f"named_struct('c', transform(filter(split({candidate}, ''), c -> c <> ''), c -> instr('{ALPHABET}', c)), 'most', {most})"
    runs = _bound(codes, "k", f"flatten(transform(sequence(0, (size(k.c) - 1) DIV {CHUNK}), b -> {chunk}))")
    # Runs of two chunks that touch are one.
    starts = "filter(r, (x, i) -> i = 0 OR x.start > r[greatest(i, 1) - 1].stop)"
    stops = "filter(r, (x, i) -> i = size(r) - 1 OR r[least(i + 1, size(r) - 1)].start > x.stop)"
    return _bound(runs, "r", f"zip_with({starts}, {stops}, (a, b) -> named_struct('start', a.start, 'stop', b.stop))")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow=ALLOW, allow_runs=ALLOW_RUNS) -> DataFrame:
    """(doc_id, text, base, spans): spans are arrays of (start, rank, stop), by start and then kind.

    ``base`` holds the spans of the fixed patterns, ``spans`` those and the
    entropy method's.  ``rank`` is the place in KINDS.  ``allow`` lists
    patterns of candidates to suppress, ``allow_runs`` those of hot runs.  Null text counts as empty and has no
    spans; every row gives one row, repeated or not; an empty table gives an
    empty result.  Columns other than the two named are not read.
    """
    span = lambda kind, x: f"named_struct('start', {x}.start, 'rank', {KINDS.index(kind)}, 'stop', {x}.stop)"
    any_of = lambda x, patterns: " OR ".join(f"{x} RLIKE '{_quoted(p)}'" for p in patterns) or "false"
    quoted = _quoted(ASSIGN)
    rank = "CASE " + " ".join(f"WHEN x.match RLIKE '{CLASSES[k]}' THEN {KINDS.index(k)}" for k in ENTROPY) + " END"
    suppressed = any_of("substring(x.match, r.start + 1, r.stop - r.start)", allow_runs)
    hot = f"transform(filter({_hot_runs('x.match')}, r -> NOT ({suppressed})), r -> named_struct('start', x.start + r.start, 'rank', q, 'stop', x.start + r.stop))"
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("a", F.expr(_found("text", ASSIGN)))
        .withColumn("k", F.expr(f"CASE WHEN contains(text, 'AKIA') THEN {_found('text', ACCESS)} END"))
        .withColumn("h", F.expr(_found("text", HEX)))
        .withColumn("c", F.expr(_found("text", CANDIDATE)))
        .withColumn("a", F.expr(f"filter(a, x -> length(regexp_extract(x.match, '{quoted}', 1)) >= {ASSIGN_MIN})"))
        .withColumn("base", F.expr(f"array_sort(concat(transform(a, x -> {span('assign', 'x')}), transform(coalesce(k, filter(a, x -> false)), x -> {span('access', 'x')}), transform(h, x -> {span('hex', 'x')})))"))
        .withColumn("hot", F.expr(f"flatten(transform(filter(c, x -> NOT ({any_of('x.match', allow)}) AND x.match RLIKE '[0-9]'), x -> {_bound(rank, 'q', hot)}))"))
        # In order of start and then kind, a span of the method goes if a base span before it reaches its stop.
        .withColumn("spans", F.expr(_bound("array_sort(concat(base, hot))", "z", f"""transform(
            filter(zip_with(z, {_before('transform(z, x -> IF(x.rank < 3, x.stop, 0))', _largest)}, (x, top) -> named_struct('x', x, 'keep', x.rank < 3 OR x.stop > top)), x -> x.keep), x -> x.x)""")))
        .select("doc_id", "text", "base", "spans")
    )


def joined(spans: str) -> F.Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at({kinds}, x.rank + 1), x.start, x.stop)), ',')")


def redact(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans are masked as one.

    Null texts stay null; texts without spans stay as they are; repeated rows
    are masked each; an empty table gives an empty result.
    """
    extra = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in extra]).alias("row"), F.col(text_col).alias("text"))
    found = scan(packed, id_col="row", text_col="text")
    # Spans that overlap are one; it goes from the first's start to the largest stop before the next one's.
    tops = f"zip_with(spans, {_before('transform(spans, x -> x.stop)', _largest)}, (x, top) -> named_struct('start', x.start, 'top', top))"
    heads = f"filter({tops}, x -> x.start >= x.top)"
    ends = "concat(transform(slice(h, 2, greatest(size(h) - 1, 0)), x -> x.top), array(array_max(transform(spans, x -> x.stop))))"
    apart = _bound(heads, "h", f"zip_with(h, {ends}, (x, stop) -> named_struct('start', x.start, 'stop', stop))")
    # The text goes through in chunks, each with the spans that reach into it; a mask stands where its span starts.
    inside = f"filter(m, x -> x.stop > p * {CHUNK} AND x.start < (p + 1) * {CHUNK})"
    from_ = f"IF(j = 0, p * {CHUNK}, i[greatest(j, 1) - 1].stop)"
    pieces = f"transform(i, (x, j) -> concat(substring(piece, {from_} - p * {CHUNK} + 1, x.start - {from_}), IF(x.start >= p * {CHUNK}, '{_quoted(mask)}', '')))"
    rest = f"IF(size(i) = 0, piece, substring(piece, i[size(i) - 1].stop - p * {CHUNK} + 1))"
    chunks = f"transform(regexp_extract_all(text, '(?s).{{1,{CHUNK}}}', 0), (piece, p) -> {_bound(inside, 'i', f'concat(array_join({pieces}, {chr(39)*2}), {rest})')})"
    masked = F.expr(_bound(apart, "m", f"array_join({chunks}, '')"))
    out = found.select("doc_id", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")).alias("text"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("doc_id")[c].alias(c) for c in docs.columns])


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    of = lambda kind: F.expr(f"CAST(size(filter(base, x -> x.rank = {KINDS.index(kind)})) AS BIGINT)")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.expr("CAST(size(spans) - size(base) AS BIGINT)").alias("n_entropy"),
    )


def _sql() -> str:
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = {"assign": assign, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    matches = " UNION ALL ".join(
        f"SELECT row_no, '{k}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT row_no, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d) WHERE len(m) > 0"
        for k, p in patterns.items()
    )
    weights = "[" + ", ".join(str(weight(c)) for c in range(WINDOW + 1)) + "]"
    allow = " OR ".join(f"regexp_matches(t, '{p}')" for p in (ALLOW[0], "^/?([A-Za-z]+[0-9]{0,4}[-_/=+])+[A-Za-z]*[0-9]{0,4}$"))
    allow_runs = " OR ".join(f"regexp_matches(substr(t, i0 + 1, i1 - i0), '{p}')" for p in ALLOW_RUNS)
    limit = "CASE " + " ".join(f"WHEN regexp_matches(t, '{CLASSES[k]}') THEN {sum_limit(ENTROPY[k])}" for k in ENTROPY) + " END"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(t, '{CLASSES[k]}') THEN '{k}'" for k in ENTROPY) + " END"
    ranks = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM documents),
m AS ({matches}),
p AS (SELECT row_no, kind, m[i] AS t, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s FROM m),
base AS (SELECT row_no, kind, s::BIGINT AS s, (s + length(t))::BIGINT AS e FROM p
         WHERE kind IN ('access', 'hex') OR kind = 'assign' AND length(regexp_extract(t, '{assign}', 2)) >= {ASSIGN_MIN}),
cand AS (SELECT row_no, t, s::BIGINT AS s, {limit} AS most, {kind} AS kind FROM p WHERE kind = 'candidate' AND NOT ({allow})),
win AS (SELECT row_no, t, s, most, kind, unnest(range(0, length(t) - {WINDOW} + 1)) AS i FROM cand),
chr AS (SELECT row_no, s, i, c, count(*) AS n FROM (SELECT row_no, s, i, unnest(string_split(substr(t, i + 1, {WINDOW}), '')) AS c FROM win) GROUP BY ALL),
ent AS (SELECT row_no, s, i, sum(({weights})[n + 1]) AS total, bool_or(c BETWEEN '0' AND '9') AS digit, bool_or(lower(c) BETWEEN 'a' AND 'z') AS letter FROM chr GROUP BY ALL),
hot AS (SELECT win.row_no, win.s, win.kind, win.t, win.i FROM win JOIN ent USING (row_no, s, i) WHERE total <= most AND digit AND letter),
step AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY row_no, s ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM hot),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY row_no, s ORDER BY i) AS r FROM step),
added AS (SELECT row_no, kind, (s + i0)::BIGINT AS s, (s + i1)::BIGINT AS e
          FROM (SELECT row_no, s, kind, any_value(t) AS t, min(i) AS i0, max(i) + {WINDOW} AS i1 FROM run GROUP BY row_no, s, kind, r) WHERE NOT ({allow_runs})),
fresh AS (SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_no = a.row_no AND b.s <= a.s AND a.e <= b.e)),
spans AS (SELECT row_no, {ranks} AS r, kind || ':' || s || ':' || e AS k, s, true AS base FROM base UNION ALL SELECT row_no, {ranks}, kind || ':' || s || ':' || e, s, false FROM fresh),
per AS (SELECT row_no, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex, count(*) FILTER (r > 2) AS n_entropy,
               string_agg(k, ',' ORDER BY s, r) FILTER (base) AS b, string_agg(k, ',' ORDER BY s, r) AS spans FROM spans GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0)::BIGINT AS n_entropy
FROM d LEFT JOIN per USING (row_no)
"""


OP1_SQL = _sql()
