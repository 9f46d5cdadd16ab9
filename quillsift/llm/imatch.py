"""Document fingerprints by I-Match with several randomised lexicons, as SQL expressions.

Terms are the lower-cased words of the whole text, cut at characters that are
no letters, digits or combining marks.  The lexicon keeps terms
within a band of inverse document frequency, ln(N / df).  A text's terms in
the lexicon, distinct and sorted by their hash, are hashed as a whole, and so
are their intersections with random subsets of the lexicon: each of DRAWS
draws has LEVELS nested subsets, of shares 1/4, 1/16 and so on, and a deepest
one of a quarter of the last (1/1024).  A subset's
hash survives exactly the edits that touch none of its terms, so small subsets
tell related long texts apart from unrelated ones and large ones do for short
texts.

Document frequencies are counted for each term (its 64-bit hash) over all
documents.  A band is a share of N, and the frequencies add up to N times the
mean number T of distinct terms of a document, so at most T * exp(greatest idf)
terms are in it, at any size of the corpus and of its vocabulary.  The lexicon
is held as two arrays of 2^BITS bits (512 KB), by two parts of the hash: testing
a text's terms needs no join.  A term out of the band passes both by chance with
probability (L / 2^BITS)^2 for a lexicon of L terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

BITS = 21
#: Least and greatest idf of the band.
IDF_BAND = (0.9, 7.6)
DRAWS = 8
LEVELS = 4
WORD_BREAK = r"[^\\p{L}\\p{M}\\p{N}]+"
#: The same in texts that hold none of OTHER_BREAK, and faster.
ASCII_BREAK = r"[\\x00-/:-@\\[-`{-\\x7F]+"
OTHER_BREAK = r"[^\\x00-\\x7F\\p{L}\\p{M}\\p{N}]"
NONE = "........"


def term_hashes(text: str) -> str:
    """SQL: sorted distinct hashes of a text's terms."""
    words = f"IF({text} RLIKE '{OTHER_BREAK}', split(lower({text}), '{WORD_BREAK}', -1), split(lower({text}), '{ASCII_BREAK}', -1))"
    return f"sort_array(array_distinct(transform(array_remove({words}, ''), w -> xxhash64(w))))"


def bucket(h: str, half: int) -> str:
    """SQL: the place of a term's hash in the first or second array of bits."""
    return f"CAST(shiftrightunsigned({h}, {BITS * half}) & {2**BITS - 1} AS INT)"


def in_band(terms: DataFrame, band=IDF_BAND) -> DataFrame:
    """terms(terms array, distinct) of all documents -> (h), the terms whose idf is in the band; documents without terms do not count."""
    # A null for each document with terms counts the documents along with the terms.
    df = materialize(terms.where(F.size("terms") > 0).select(F.explode(F.concat(F.array(F.lit(None).cast("long")), "terms")).alias("h")).groupBy("h").agg(F.count("*").alias("df")), "df")
    docs = df.where("h IS NULL").agg(F.max("df")).first()[0] or 1
    return df.where(F.col("h").isNotNull() & F.log(F.lit(float(docs)) / F.col("df")).between(*band)).select("h")


def lexicon(terms: DataFrame, band=IDF_BAND) -> tuple[str, str]:
    """terms(terms array, distinct) of all documents -> SQL of the lexicon's two arrays of bits, 64 to an element.

    The 2^BITS / 64 words of each come to the driver and go into the
    expressions as constants.
    """
    both = F.array(*[F.struct(F.lit(half).alias("half"), F.expr(bucket("h", half)).alias("bucket")) for half in (0, 1)])
    places = in_band(terms, band).select(F.explode(both).alias("x")).select("x.*")
    words = places.groupBy("half", F.expr("bucket DIV 64").cast("int").alias("i")).agg(F.expr("bit_or(shiftleft(1L, CAST(bucket % 64 AS INT)))").alias("word"))
    bits = [[0] * (2**BITS // 64) for _ in (0, 1)]
    for r in words.collect():
        bits[r["half"]][r["i"]] = r["word"]
    return tuple(f"from_json('[{','.join(map(str, x))}]', 'array<bigint>')" for x in bits)


def signature(terms: str, bits: tuple[str, str]) -> str:
    """SQL: the array of subset hashes (8 hex digits each, NONE for an empty subset) of sorted term hashes.

    The hash of all comes first, then LEVELS nested subsets and the deepest one for each draw.
    Without a term in the lexicon the text is known by all its terms.
    """
    word = lambda half: f"CAST(shiftrightunsigned(h, {BITS * half + 6}) & {2 ** (BITS - 6) - 1} AS INT)"
    place = lambda half: f"CAST({'h' if half == 0 else f'shiftrightunsigned(h, {BITS * half})'} & 63 AS INT)"
    known = f"filter({terms}, h -> " + " AND ".join(f"(shiftrightunsigned({x}[{word(half)}], {place(half)}) & 1) = 1" for half, x in enumerate(bits)) + ")"
    short = lambda a: f"IF(size({a}) = 0, '{NONE}', lower(substring(lpad(hex(xxhash64({a})), 16, '0'), 9)))"
    # A draw has 2 * LEVELS bits of a term's hash of its own; level l holds the terms whose low 2 * l of them are 0.
    # All 64 bits are then dealt, so the deepest level takes two bits for each draw from a second hash.
    def nest(draw: int, level: int, above: str) -> str:
        mask = (4**level - 1) << (2 * LEVELS * draw)
        mask = mask - 2**64 if mask >= 2**63 else mask
        here = f"g{draw}_{level}"
        deepest = f"filter({here}, h -> (xxhash64(h, 1) & {3 << (2 * draw)}L) = 0)"
        below = nest(draw, level + 1, here) if level < LEVELS else f"transform(array({deepest}), d{draw} -> {short(f'd{draw}')})"
        out = f"concat(array({short(here)}), {below})"
        return f"transform(array(filter({above}, h -> (h & {mask}L) = 0)), {here} -> {out})[0]"

    return f"""transform(transform(array({known}), k -> IF(size(k) = 0, {terms}, k)), t ->
        concat(array({short('t')}), {', '.join(nest(draw, 1, 't') for draw in range(DRAWS))}))[0]"""


def likeness(a: str, b: str) -> F.Column:
    """Share of equal subset hashes among those that are not empty on both sides; 1 if all are empty, that is for texts without terms."""
    pairs = f"zip_with({a}, {b}, (x, y) -> CASE WHEN x = '{NONE}' AND y = '{NONE}' THEN NULL WHEN x = y THEN 1 ELSE 0 END)"
    return F.expr(f"aggregate({pairs}, named_struct('n', 0, 's', 0), (st, x) -> IF(x IS NULL, st, named_struct('n', st.n + 1, 's', st.s + x)), st -> IF(st.n = 0, 1.0D, CAST(st.s AS DOUBLE) / st.n))")


def _parts(signature: str) -> tuple[F.Column, F.Column]:
    """A signature without the draws' deepest hashes, and those alone."""
    deepest = f"i > 0 AND i % {LEVELS + 1} = 0"
    return F.expr(f"filter({signature}, (x, i) -> NOT ({deepest}))"), F.expr(f"filter({signature}, (x, i) -> {deepest})")


def fingerprints(docs: DataFrame, bits: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, signature, deepest) of every row, by a lexicon; null text counts as empty, equal texts have equal signatures."""
    terms = docs.select(F.col(id_col).alias("id"), F.expr(term_hashes(f"coalesce(`{text_col}`, '')")).alias("terms"))
    signed = terms.select("id", F.expr(signature("terms", bits)).alias("all"))
    main, deepest = _parts("all")
    return signed.select("id", main.alias("signature"), deepest.alias("deepest"))


def next_ids(ids: DataFrame) -> DataFrame:
    """ids(doc_id), distinct -> (doc_id, next_id), the next larger id, for the last the first.

    Ids are dealt by range and sorted within each range; a range's last id
    goes on with the first of the next, found in a table with a row for each range.
    """
    cut = materialize(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    inner = cut.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    firsts = cut.groupBy("part").agg(F.min("doc_id").alias("first"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(every)).alias("after"))
    return inner.join(F.broadcast(after), "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))  # a row for each shuffle partition


def edited_fingerprints(docs: DataFrame, band=IDF_BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, next_id, n_chars, edited_sha256, signature, edited_signature, deepest, edited_deepest).

    The last two hold the hash of each draw's deepest subset, the others are in the signatures.

    The edited text is the text with its last floor(n_chars / 4) code points
    replaced by the first as many of the next document, by ascending id (after
    the last: the first).  Only those beginnings are moved to their document.
    Rows with a null id have no next document; of several rows with one id the
    one whose beginning is smallest is the next document.  Null text counts as
    empty; an empty table gives an empty result.  Other columns are not read.
    """
    named = lambda c, name, kind: F.col(c) if c == name and dict(docs.dtypes)[c] == kind else F.col(c).cast(kind).alias(name)
    given = docs.select(named(id_col, "doc_id", "bigint"), named(text_col, "text", "string"))
    whole_text = F.coalesce(F.col("text"), F.lit(""))
    bits = lexicon(given.select(F.expr(term_hashes("coalesce(text, '')").removeprefix("sort_array(").removesuffix(")")).alias("terms")), band)  # in any order
    known = given.where(F.col("doc_id").isNotNull())
    order = materialize(next_ids(known.select("doc_id").distinct()), "next")
    # How much of each document its predecessor takes: the most that any row of it needs.
    most = known.groupBy("doc_id").agg(F.max(F.floor(F.length(whole_text) / 4)).cast("int").alias("need"))
    need = materialize(most.join(order, "doc_id").select(F.col("doc_id").alias("before"), F.col("next_id").alias("doc_id"), "need"), "need")
    # Both joins deal the texts by doc_id in one and the same exchange, which Spark reuses: both read ``known`` as it is.
    begun = known.join(need.hint("merge"), "doc_id").select(F.col("before").alias("doc_id"), F.substring(whole_text, F.lit(1), F.col("need")).alias("head"))
    heads = begun.groupBy("doc_id").agg(F.min("head").alias("head"))
    taken = order.join(heads, "doc_id", "left")
    whole = known.join(taken.hint("merge"), "doc_id", "left")
    whole = whole.unionByName(given.where(F.col("doc_id").isNull()).withColumn("next_id", F.lit(None).cast("long")).withColumn("head", F.lit(None).cast("string")))
    cut = "CAST(length(text) DIV 4 AS INT)"
    edited = whole.select("doc_id", "next_id", whole_text.alias("text"), "head").select("doc_id", "next_id", "text", F.expr(f"concat(substring(text, 1, length(text) - {cut}), substring(coalesce(head, ''), 1, {cut}))").alias("edited"))
    facts = (F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    terms = edited.select("doc_id", "next_id", *facts, F.expr(term_hashes("text")).alias("terms"), F.expr(term_hashes("edited")).alias("edited_terms"))
    signatures = (F.expr(signature("terms", bits)).alias("all"), F.expr(signature("edited_terms", bits)).alias("edited_all"))
    signed = terms.select("doc_id", "next_id", "n_chars", "edited_sha256", *signatures)
    (main, deepest), (edited_main, edited_deepest) = _parts("all"), _parts("edited_all")
    return signed.select("doc_id", "next_id", "n_chars", "edited_sha256", main.alias("signature"), edited_main.alias("edited_signature"), deepest.alias("deepest"), edited_deepest.alias("edited_deepest"))


def op4_imatch(spark, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    every = [F.concat(c, d).alias(c) for c, d in (("signature", "deepest"), ("edited_signature", "edited_deepest"))]
    signed = materialize(found.select("doc_id", "next_id", "n_chars", "edited_sha256", *every), "signed")
    per_id = signed.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("next_id")).agg(F.min("signature").alias("next_signature"))
    joined = signed.join(per_id, "next_id", "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256",
        F.array_join("signature", "").alias("fingerprint"), F.array_join("edited_signature", "").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        F.when(F.col("next_signature").isNotNull(), likeness("signature", "next_signature")).otherwise(0.0).alias("near_next"),
    )
