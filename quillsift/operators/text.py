"""Text preparation: page blocks, line cleaning, lemmas, sentences, tokens, chunks.

All of it is SQL expressions inside one projection, so a scan that needs
sentences never shuffles for them.  Patterns spell out Unicode classes, which
Java and other SQL engines read alike.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The filters of line cleaning, and the token rule.
URL_LINE = r"^https?://([a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}"
DIGIT_LINE = r"^\p{Nd}+$"
SYMBOL_LINE = r"^[^\p{L}\p{N}_\s\p{Z}]+$"
TOKEN = r"^[a-z]+[a-z0-9-]*[a-z0-9]+$"
CHUNK_CHARS = 500_000
MIN_WORDS = 3

#: The same filters in forms that Java matches without recursion and in one pass: labels up to the
#: first dot that two letters follow, and a token as its first character, its middle and its last.
URL_START = r"^https?://(?:[a-zA-Z0-9-]++\.(?![a-zA-Z]{2}))*+[a-zA-Z0-9-]++\.[a-zA-Z]{2}"
TOKEN_RUN = r"(?<![^\s\p{Z}])[a-z][a-z0-9-]*[a-z0-9](?![^\s\p{Z}])"

DROPPED_MARKUP = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
#: Stands for a ``<`` while markup is dropped; a code point that Unicode keeps out of texts.
UNOPENED = "\uffff"
BLOCK_TAG = r"(?i)</?(p|div|br|hr|h[1-6]|ul|ol|li|table|tr|td|th|title|head|body|html|section|article|nav|header|footer|blockquote|pre|main|aside)\b[^>]*>"
ENTITIES = (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&#39;", "'"), ("&amp;", "&"))


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^[\s\p{Z}]++|(?<![\s\p{Z}])[\s\p{Z}]++$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\p{Z}]+", " ")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a column named inside a lambda may be computed for each of its elements."""
    return F.transform(F.array(value), body)[0]


def _unopened(html: Column) -> Column:
    """Openings of dropped markup that nothing closes, marked, so that every other one ends the search it starts."""

    def mark(name: str, close: str):
        def of(x: Column) -> Column:
            small = F.translate(x, ascii_uppercase, ascii_lowercase)
            at = F.length(x) - F.length(F.substring_index(small, close, -1))
            cut = lambda i: F.concat(F.substring(x, F.lit(1), i), F.regexp_replace(F.substring(x, i + 1, F.length(x) - i), f"(?i)<(?={name})", UNOPENED))
            return F.when(F.contains(small, F.lit("<" + name)), let(at, cut)).otherwise(x)

        return of

    for name, close in (("script", "</script>"), ("style", "</style>"), ("!--", "-->")):
        html = let(html, mark(name, close))
    return html


def _closed(text: Column, tag: str, by: str) -> Column:
    """Tags replaced up to the last ``>``; beyond it none is closed, and looking for its end from each ``<`` takes quadratic time."""
    head = lambda x, rest: F.substring(x, F.lit(1), F.length(x) - F.length(rest))
    return let(text, lambda x: let(F.substring_index(x, ">", -1), lambda rest: F.concat(F.regexp_replace(head(x, rest), tag, by), rest)))


def html_lines(html: Column) -> Column:
    """Non-blank text blocks of a page."""
    text = F.replace(F.regexp_replace(_unopened(html), DROPPED_MARKUP, ""), F.lit(UNOPENED), F.lit("<"))
    text = _closed(_closed(text, BLOCK_TAG, "\n"), r"<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > 0)


def page_blocks(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> (page_id, line_no, line)."""
    return pages.select("page_id", F.posexplode(html_lines(F.col("html"))).alias("line_no", "line"))


def clean_line_array(text: Column) -> Column:
    """Kept lines of a text, lower-cased and squeezed; empty lines stay."""
    kept = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: ~(x.rlike(URL_START) | x.rlike(DIGIT_LINE) | x.rlike(SYMBOL_LINE)))
    return F.transform(kept, lambda x: squeeze(F.lower(x)))


def clean_text(text: Column) -> Column:
    return F.array_join(clean_line_array(text), " ")


def lemma(token: Column) -> Column:
    """Suffix rules for English plurals; other tokens stay."""
    return (
        F.when(token.rlike("^[A-Za-z]{2,}ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("^[A-Za-z]+(ss|x|ch|sh)es$"), F.regexp_replace(token, "es$", ""))
        .when(token.rlike("^[A-Za-z]+[A-Za-rt-z]s$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def padded(text: Column) -> Column:
    """Punctuation as tokens of its own, single spaces."""
    return strip(squeeze(F.regexp_replace(text, r"([^\p{L}\p{N}\s\p{Z}-])", " $1 ")))


def lemmatize(text: Column) -> Column:
    """``lemma`` of every token of the padded text, by two passes over the text (no rule makes a case for another)."""
    y = F.regexp_replace(padded(text), r"(?<![^ ])([A-Za-z]{2,})ies(?![^ ])", "$1y")
    return F.regexp_replace(y, r"(?<![^ ])(?:([A-Za-z]+(?:ss|x|ch|sh))es|([A-Za-z]+[A-Za-rt-z])s)(?![^ ])", "$1$2")


def lemma_array(text: Column) -> Column:
    return F.filter(F.split(lemmatize(text), " "), lambda t: t != "")


def word_count(piece: Column) -> Column:
    """Tokens that start with a letter."""
    return F.regexp_count(piece, F.lit(r"(?<![^ ])\p{L}"))


def sentence_array(text: Column, min_words: int = MIN_WORDS) -> Column:
    """Sentences of a lemmatised text: what ends in . ! ? is emitted if it has enough words, else it goes on into the next.

    A rest without an end mark is emitted if it has enough words, else it joins
    the last sentence, and without one it is lost.
    """
    pieces = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]|[^.!?]+$"), F.lit(0)), strip), lambda p: p != "")
    counted = F.transform(pieces, lambda p: F.struct(p.alias("p"), word_count(p).alias("n"), p.rlike("[.!?]$").alias("mark")))
    return F.transform(F.array(counted), lambda ps: _merged(ps, min_words))[0]


#: Pieces of a text that are walked through at a time.
BLOCK = 64


def _merged(ps: Column, min_words: int) -> Column:
    """Sentences of pieces (p, n, mark).

    Spark copies an accumulator at every step, so the walk holds whether each
    piece of a block ends a sentence, and the texts are joined by position.
    """
    none = F.array().cast("array<int>")
    last = F.size(ps) - 1
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)

    def step(st, i):
        n = st["n"] + ps[i]["n"]
        ends = ps[i]["mark"] & (n >= min_words)
        return F.struct(F.when(ends, 0).otherwise(n).alias("n"), F.concat(st["out"], F.when(ends, F.array(i)).otherwise(none)).alias("out"))

    def block(st, b):
        part = F.aggregate(span(b * BLOCK, F.least((b + 1) * BLOCK - 1, last)), F.struct(st["n"].alias("n"), none.alias("out")), step)
        return F.transform(F.array(part), lambda x: F.struct(x["n"].alias("n"), F.concat(st["out"], F.array(x["out"])).alias("out")))[0]

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<array<int>>").alias("out"))
    walk = F.aggregate(span(F.lit(0), F.when(last >= 0, F.floor(last / BLOCK).cast("int")).otherwise(-1)), start, block)

    def cut(st):
        ends = F.flatten(st["out"])
        return F.transform(F.array(ends), lambda e: _joined(ps, e, st["n"] >= min_words))[0]

    return F.transform(F.array(walk), cut)[0]


def _joined(ps: Column, ends: Column, whole_rest: Column) -> Column:
    """The pieces between ends as texts; a rest is a text of its own, or joins the last one, or is lost."""
    last, n = F.size(ps) - 1, F.size(ends)
    after = F.when(n > 0, F.element_at(ends, -1)).otherwise(-1)
    # Where the rest joins the last sentence, that one ends with the text.
    stops = F.when((n > 0) & ~whole_rest, F.transform(ends, lambda e, i: F.when(i == n - 1, last).otherwise(e))).when((after < last) & whole_rest, F.concat(ends, F.array(last))).otherwise(ends)
    begins = F.transform(stops, lambda e, i: F.when(i == 0, 0).otherwise(ends[F.greatest(i, F.lit(1)) - 1] + 1))
    return F.zip_with(begins, stops, lambda a, b: F.array_join(F.transform(F.sequence(a, b), lambda i: ps[i]["p"]), " "))


def sentences(docs: DataFrame, min_words: int = MIN_WORDS, lemmatizer=lemmatize, splitter=None) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, sent_id, sentence); ids are document-wide and start at 0.

    ``lemmatizer`` (of texts) and ``splitter`` (of lemmatised texts into arrays
    of sentences) may be plug-ins, see ``functions.plugins``.
    """
    split = splitter or (lambda c: sentence_array(c, min_words))
    return docs.select("doc_id", F.posexplode(split(lemmatizer(F.col("text")))).alias("sent_id", "sentence"))


def assemble(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, page, line_no, line) -> (doc_id, text): a document's lines in order of its pages."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "line_no", "line")))  # of one document
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def token_array(text: Column) -> Column:
    """Index tokens: lower-cased, letters first, two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RUN), F.lit(0))


def chunk_array(text: Column, size: int = CHUNK_CHARS) -> Column:
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def dedup_sentences(rows: DataFrame) -> DataFrame:
    """The first row of each sentence text, by (doc_id, sent_id); a running minimum, so equal texts meet as partial results."""
    first = rows.groupBy("sentence").agg(F.min(F.struct("doc_id", "sent_id")).alias("at"))
    return first.select("at.doc_id", "at.sent_id", "sentence")


def file_number(stem: Column) -> Column:
    """The first run of digits, else the largest number (sorts last)."""
    return F.coalesce(F.regexp_extract(stem, r"\d+", 0).try_cast("long"), F.lit(2**63 - 1))
