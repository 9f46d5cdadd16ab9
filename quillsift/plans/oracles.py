"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from ..operators import associations, context, lemmas, text, topics

# The lists that the queries use; a test holds them equal.
KEYWORD_TERMS = [("tion", 0, 1), ("the", 1, 2), ("of", 2, 1), ("ble", 3, 1), ("zeta", 4, 1), ("que", 6, 1)]
QUESTION = "the ble of the tion and que"

WS = r"[\s\p{Z}]+"
STRIP = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{WS}', ' ', 'g')"


def lemma(t: str) -> str:
    return (
        f"CASE WHEN regexp_matches({t}, '^[A-Za-z]{{2,}}ies$') THEN regexp_replace({t}, 'ies$', 'y') "
        f"WHEN regexp_matches({t}, '^[A-Za-z]+(ss|x|ch|sh)es$') THEN regexp_replace({t}, 'es$', '') "
        f"WHEN regexp_matches({t}, '^[A-Za-z]+[A-Za-rt-z]s$') THEN regexp_replace({t}, 's$', '') ELSE {t} END"
    )


PADDED = strip(squeeze(r"regexp_replace(text, '([^\p{L}\p{N}\s\p{Z}-])', ' \1 ', 'g')"))
DOCS = "docs AS (SELECT doc_id, text, source FROM documents WHERE trim(text) <> '')"
LEMMAS = f"lemmas AS (SELECT doc_id, list_transform(list_filter(string_split({PADDED}, ' '), lambda t: t <> ''), lambda t: {lemma('t')}) AS l FROM docs)"
SENTENCES = rf"""{DOCS}, {LEMMAS},
pieces AS (SELECT doc_id, i, {strip('p[i]')} AS p, len(p) AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(array_to_string(l, ' '), '[^.!?]*[.!?]|[^.!?]+$') AS p FROM lemmas))),
counted AS (SELECT *, len(regexp_extract_all(' ' || p, ' \p{{L}}')) AS w, regexp_matches(p, '[.!?]$') AS mark FROM pieces),
walk AS (SELECT doc_id, i, n, CASE WHEN mark AND w >= 3 THEN p END AS emitted, CASE WHEN mark AND w >= 3 THEN '' ELSE p END AS cur, CASE WHEN mark AND w >= 3 THEN 0 ELSE w END AS c FROM counted WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.i, x.n, CASE WHEN mark AND w + c >= 3 THEN CASE WHEN cur = '' THEN p ELSE cur || ' ' || p END END,
         CASE WHEN mark AND w + c >= 3 THEN '' ELSE CASE WHEN cur = '' THEN p ELSE cur || ' ' || p END END, CASE WHEN mark AND w + c >= 3 THEN 0 ELSE w + c END
  FROM walk JOIN counted x ON x.doc_id = walk.doc_id AND x.i = walk.i + 1),
whole AS (SELECT doc_id, i, emitted AS s FROM walk WHERE emitted IS NOT NULL UNION ALL SELECT doc_id, i + 1, cur FROM walk WHERE i = n AND cur <> '' AND c >= 3),
rest AS (SELECT doc_id, cur FROM walk WHERE i = n AND cur <> '' AND c < 3),
sents AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS sent_id,
                 CASE WHEN cur IS NOT NULL AND i = max(i) OVER (PARTITION BY doc_id) THEN s || ' ' || cur ELSE s END AS sentence
          FROM whole LEFT JOIN rest USING (doc_id))"""


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{WS}'), lambda t: regexp_matches(t, '{text.TOKEN}'))"


POSTS = f"posts AS (SELECT DISTINCT doc_id, sent_id, unnest({tokens('sentence')}) AS term FROM sents)"
KW = "kw AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {o}, {n})" for t, o, n in KEYWORD_TERMS) + ") v(term, ord, times))"
HITS = f"{SENTENCES}, {POSTS}, {KW}, hits AS (SELECT posts.* FROM posts WHERE term IN (SELECT term FROM kw))"
SCORES = f"""{HITS}, lens AS (SELECT doc_id, term, count(*) AS n FROM hits GROUP BY ALL),
scores AS (SELECT doc_id, count(*)::BIGINT AS coverage, sum(n * times)::BIGINT AS total, (16 * count(*) + sum(n * times))::BIGINT AS points FROM lens JOIN kw USING (term) GROUP BY doc_id)"""
COUNTS = f"{HITS}, counts AS (SELECT doc_id, sent_id, sum(times)::BIGINT AS hits FROM hits JOIN kw USING (term) GROUP BY ALL)"

BLOCKS = f"regexp_replace(regexp_replace(regexp_replace(html, '{text.DROPPED_MARKUP}', '', 'g'), '{text.BLOCK_TAG}', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _char in text.ENTITIES:
    BLOCKS = f"replace({BLOCKS}, {quoted(_entity)}, {quoted(_char)})"
HTML_LINES = f"list_filter(list_transform(string_split({BLOCKS}, chr(10)), lambda x: {strip('x')}), lambda x: length(x) > 0)"
PAGE_LINES = f"SELECT page_id, url || chr(10) || page_id || chr(10) || '***' || chr(10) || '' || chr(10) || array_to_string({HTML_LINES}, chr(10)) AS text FROM pages"
CLEAN = (
    f"list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), "
    f"lambda x: NOT (regexp_matches(x, '{text.URL_LINE}') OR regexp_matches(x, '{text.DIGIT_LINE}') OR regexp_matches(x, '{text.SYMBOL_LINE}'))), lambda x: {squeeze('lower(x)')})"
)


def positions(rows: str, keys: str, value: str, names: tuple[str, str]) -> str:
    """posexplode: one row for each element of the list ``value``."""
    return f"SELECT {keys}, (i - 1)::INT AS {names[0]}, v[i] AS {names[1]} FROM (SELECT {keys}, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT {keys}, {value} AS v FROM {rows}))"


PACKED = """, bestrows AS (SELECT *, coalesce(sum(length(sentence) + {sep}) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {initial} AS used,
            row_number() OVER (ORDER BY {order}) AS place FROM {rows}), packed AS (SELECT * FROM bestrows WHERE used <= 1000)"""
BY_DOCUMENT = (
    SCORES
    + ", counts AS (SELECT doc_id, sent_id, sum(times)::BIGINT AS hits FROM hits JOIN kw USING (term) GROUP BY ALL), ranks AS (SELECT doc_id, row_number() OVER (ORDER BY points DESC, doc_id) AS rank FROM scores), "
    "ranked AS (SELECT * FROM counts JOIN sents USING (doc_id, sent_id) JOIN ranks USING (doc_id))"
    + PACKED.format(sep=1, initial=0, order="rank, hits DESC, sent_id", rows="ranked")
)


def bm25(units: str, keys: str) -> str:
    return f"""units AS (SELECT {keys}, t, len(t) AS dl FROM (SELECT {keys}, {tokens(units)} AS t FROM {'docs' if units == 'text' else 'sents'})),
stats AS (SELECT count(*) AS units, avg(dl) AS avgdl FROM units),
tf AS (SELECT {keys}, dl, term, count(*) AS tf FROM (SELECT {keys}, dl, unnest(t) AS term FROM units) WHERE term IN (SELECT term FROM kw) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT {keys}, round(sum(ln(1 + (units - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 4) AS score
FROM tf JOIN df USING (term), stats GROUP BY {keys}"""


def bm25_top(units: str, keys: str, n: int) -> str:
    scored = bm25(units, keys)
    head, _, last = scored.rpartition("\nSELECT ")
    return f"{head}, scored AS (SELECT {last}) SELECT rank::INT AS rank, {keys}, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, {keys}) AS rank FROM scored) WHERE rank <= {n}"


ASSOCIATED = f"""{SENTENCES}, {KW}, toks AS (SELECT row_number() OVER () AS s, {tokens('sentence')} AS t FROM sents),
places AS MATERIALIZED (SELECT s, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM toks),
pairs AS MATERIALIZED (SELECT least(a.x, b.x) AS a, greatest(a.x, b.x) AS b, count(*) AS n FROM places a JOIN places b ON a.s = b.s AND b.i > a.i AND b.i <= a.i + {associations.WINDOW} GROUP BY ALL),
cooc AS MATERIALIZED (SELECT a AS term, b AS ctx, CASE WHEN a = b THEN 2 * n ELSE n END AS n FROM pairs UNION ALL SELECT b, a, n FROM pairs WHERE a <> b),
totals AS MATERIALIZED (SELECT term, sum(n)::BIGINT AS n FROM cooc GROUP BY term),
ppmi AS MATERIALIZED (SELECT * FROM (SELECT term, ctx, ln(c.n::DOUBLE * (SELECT sum(n) FROM totals)::DOUBLE / (a.n::DOUBLE * b.n)) AS w FROM cooc c JOIN totals a USING (term) JOIN totals b ON b.term = ctx) WHERE w > 0),
lengths AS (SELECT term, sqrt(sum(w * w)) AS l FROM ppmi GROUP BY term),
dots AS (SELECT q.term AS q, p.term, sum(q.w * p.w) AS d FROM ppmi q JOIN ppmi p USING (ctx) WHERE q.term IN (SELECT term FROM kw) AND p.term NOT IN (SELECT term FROM kw) GROUP BY ALL),
cosines AS (SELECT q, dots.term, round(d / (a.l * b.l), 6) AS c FROM dots JOIN lengths a ON a.term = q JOIN lengths b ON b.term = dots.term JOIN totals t ON t.term = dots.term WHERE t.n >= {associations.LEAST}),
assoc AS (SELECT q AS term, rank, term AS associate, c AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, term) AS rank FROM cosines) WHERE rank <= {associations.ASSOCIATES})"""


VEC = "vecs AS (SELECT label AS doc, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
REPS = f"{VEC}, dims AS (SELECT doc, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM vecs), means AS (SELECT doc, i, avg(x) AS x FROM dims GROUP BY ALL), reps AS (SELECT doc, list(x ORDER BY i) AS v FROM means GROUP BY doc)"
REP_ROWS = f"WITH {REPS} SELECT doc, (i - 1)::INT AS i, round(x, 6) AS x FROM means"
COS = "coalesce(list_cosine_similarity({0}, {1}), 0)"


def two_stage(docs: int, sentences: int) -> str:
    return f"""WITH {REPS}, q AS (SELECT v FROM vecs WHERE id = 0),
best AS (SELECT doc FROM (SELECT reps.doc, row_number() OVER (ORDER BY {COS.format('reps.v', 'q.v')} DESC, reps.doc) AS r FROM reps, q) WHERE r <= {docs}),
s AS (SELECT vecs.doc, id, {COS.format('vecs.v', 'q.v')} AS score FROM vecs JOIN best USING (doc), q)
SELECT rank::INT AS rank, doc, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {sentences}"""


STOPS = ", ".join(f"'{w}'" for w in topics.STOP_WORDS)
TFIDF = rf"""{DOCS}, words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{topics.TERM}')) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term NOT IN ({STOPS}) GROUP BY ALL),
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw),
sizes AS (SELECT source AS topic, count(*) AS n FROM docs GROUP BY source),
cents AS (SELECT source AS topic, term, sum(w) / any_value(n) AS w FROM weights JOIN docs USING (doc_id) JOIN sizes ON topic = source GROUP BY ALL)"""
MATCH = rf"""{TFIDF}, qtf AS (SELECT term, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(lower('{QUESTION}'), '{topics.TERM}')) AS term) WHERE term NOT IN ({STOPS}) GROUP BY term),
qraw AS (SELECT term, tf * idf AS w FROM qtf JOIN vocab USING (term)), q AS (SELECT term, w / sqrt(sum(w * w) OVER ()) AS qw FROM qraw),
lengths AS (SELECT topic, sqrt(sum(w * w)) AS length FROM cents GROUP BY topic),
sims AS (SELECT topic, round(sum(w * qw) / any_value(length), 6) AS sim FROM cents JOIN q USING (term) JOIN lengths USING (topic) GROUP BY topic)"""
EMBEDDED = rf"""w AS (SELECT doc_id, sent_id, unnest(regexp_extract_all(lower(sentence), '{topics.TERM}')) AS t FROM sents),
b AS (SELECT doc_id, sent_id, (('0x' || substr(md5(t), 1, 6))::INT % 64)::INT AS i, count(*) AS c FROM w GROUP BY ALL),
emb AS (SELECT doc_id, sent_id, i, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, sent_id)), 6) AS x FROM b)"""


def asked(docs: int, sentences: int) -> str:
    """The best sentences of the question's best documents, as ``found``."""
    return f"""{SENTENCES}, {EMBEDDED}, n AS (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id),
reps AS MATERIALIZED (SELECT doc_id, i, round(sum(x) / any_value(n), 6) AS x FROM emb JOIN n USING (doc_id) GROUP BY doc_id, i),
qb AS (SELECT ('0x' || substr(md5(t), 1, 6))::INT % 64 AS i, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower('{QUESTION}'), '{topics.TERM}')) AS t) GROUP BY ALL),
q AS MATERIALIZED (SELECT i::INT AS i, c / sqrt(sum(c * c) OVER ()) AS x FROM qb),
sim AS (SELECT doc_id, round(coalesce(sum(r.x * q.x), 0) / sqrt(sum(r.x * r.x)), 6) AS s FROM reps r LEFT JOIN q USING (i) GROUP BY doc_id),
best AS MATERIALIZED (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM sim) WHERE r <= {docs}),
each AS (SELECT doc_id, sent_id, round(coalesce(sum(e.x * q.x), 0) / sqrt(sum(e.x * e.x)), 6) AS s FROM (SELECT * FROM emb WHERE doc_id IN (SELECT doc_id FROM best)) e LEFT JOIN q USING (i) GROUP BY ALL),
found AS (SELECT rank, doc_id, sent_id, s AS score FROM (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id, sent_id) AS rank FROM each) WHERE rank <= {sentences})"""


def asked_context(docs: int) -> str:
    packed = PACKED.format(sep=1, initial=0, order="rank", rows="texts")
    return f"WITH RECURSIVE {asked(docs, 100)}, texts AS (SELECT found.*, sentence FROM found JOIN sents USING (doc_id, sent_id)){packed} SELECT place::INT AS place, doc_id, sent_id, used::BIGINT AS used, sentence FROM packed"


def pairs(rows: list[tuple[str, str]]) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ")"


EDITS = f"""{DOCS}, given AS (SELECT form, lemma, len(list_filter(range(1, least(length(form), length(lemma)) + 1), lambda i: form[1:i] = lemma[1:i])) AS p FROM {pairs(lemmas.regular_pairs())} v(form, lemma)),
scripts AS (SELECT form, length(form) - p AS cut, lemma[p + 1:] AS ending FROM given),
each AS (SELECT right(form, n) AS suffix, cut, ending FROM (SELECT *, unnest(range(greatest(1, cut), least({lemmas.LONGEST}, length(form) - 1) + 1)) AS n FROM scripts)),
counts AS (SELECT suffix, cut, ending, count(*) AS n FROM each GROUP BY ALL),
best AS (SELECT suffix, cut, ending FROM (SELECT *, sum(n) OVER (PARTITION BY suffix) AS forms, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, ending) AS r FROM counts) WHERE r = 1 AND forms >= {lemmas.LEAST}),
words AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower({PADDED}), ' ')) AS w FROM docs) WHERE w <> '' GROUP BY w),
tails AS (SELECT w, unnest(range(1, least({lemmas.LONGEST}, length(w)) + 1)) AS k FROM (SELECT w FROM words UNION SELECT form FROM given)),
decided AS (SELECT w, CASE WHEN length(w) - arg_max(cut, k) >= 2 THEN left(w, length(w) - arg_max(cut, k)) || arg_max(ending, k) ELSE w END AS lemma FROM tails JOIN best ON suffix = right(w, k) GROUP BY w),
irregular AS (SELECT form, min(lemma) AS lemma FROM {pairs(lemmas.irregular_pairs())} o(form, lemma) GROUP BY form),
wrong AS (SELECT form, g.lemma FROM (SELECT form, min(lemma) AS lemma FROM given GROUP BY form) g LEFT JOIN decided ON w = form WHERE g.lemma <> coalesce(decided.lemma, form)),
lemma_of AS (SELECT w, n, coalesce(o.lemma, wrong.lemma, decided.lemma, w) AS lemma FROM words LEFT JOIN decided USING (w) LEFT JOIN irregular o ON o.form = w LEFT JOIN wrong ON wrong.form = w)"""
WHOLE_WORDS = r"len(list_filter(string_split_regex(sentence, '[^\p{L}\p{N}_]+'), lambda t: t IN (%s)))"

ORACLES = {
    "page_blocks": positions("pages", "page_id", HTML_LINES, ("line_no", "line")),
    "clean_lines": positions(f"({PAGE_LINES})", "page_id", CLEAN, ("line_no", "line")),
    "clean_text": f"SELECT page_id, array_to_string({CLEAN}, ' ') AS text FROM ({PAGE_LINES})",
    "lemma_tokens": f"WITH {DOCS}, {LEMMAS} SELECT doc_id, token, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(l) AS token FROM lemmas) GROUP BY ALL",
    "lemma_edits": f"WITH {EDITS} SELECT lemma, count(*)::BIGINT AS forms, sum(n)::BIGINT AS n FROM lemma_of GROUP BY lemma",
    "split_sentences": f"WITH RECURSIVE {SENTENCES} SELECT * FROM sents",
    "valid_tokens": f"WITH {DOCS} SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest({tokens('text')}) AS term FROM docs) GROUP BY term",
    "chunk_text": "SELECT doc_id, i::INT AS chunk, substr(text, i * 1000 + 1, 1000) AS part FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) AS i FROM documents WHERE trim(text) <> '')",
    "dedup_sentences": f"WITH RECURSIVE {SENTENCES} SELECT doc_id, sent_id, sentence FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY doc_id, sent_id) AS r FROM sents) WHERE r = 1",
    "file_number": r"SELECT stem, coalesce(try_cast(nullif(regexp_extract(stem, '\d+'), '') AS BIGINT), 9223372036854775807) AS number FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'embeddings' || doc_id WHEN doc_id % 3 = 1 THEN 'pdf_' || doc_id || '_v2' ELSE 'sentences' END AS stem FROM documents)",
    "inverted_index": f"WITH RECURSIVE {SENTENCES}, {POSTS} SELECT doc_id, term, list(sent_id ORDER BY sent_id) AS postings FROM posts GROUP BY ALL",
    "merge_postings": f"WITH RECURSIVE {SENTENCES}, {POSTS} SELECT doc_id, term, list(sent_id ORDER BY sent_id) AS postings FROM posts GROUP BY ALL",
    "stored_index": f"WITH RECURSIVE {SENTENCES}, {POSTS} SELECT doc_id, term, list(sent_id ORDER BY sent_id) AS postings FROM posts GROUP BY ALL",
    "index_json": f"WITH RECURSIVE {SENTENCES}, {POSTS} SELECT doc_id, term, list(sent_id ORDER BY sent_id) AS postings FROM posts GROUP BY ALL",
    "raw_texts": "SELECT doc_id, text FROM documents WHERE trim(text) <> ''",
    "page_files": positions("pages", "page_id", HTML_LINES, ("line_no", "line")),
    "pdf_blocks": positions("pages", "page_id", HTML_LINES, ("line_no", "line")),
    "assemble_pages": f"SELECT page_id % 50 AS doc_id, string_agg(line, chr(10) ORDER BY page_id, line_no) AS text FROM ({positions('pages', 'page_id', HTML_LINES, ('line_no', 'line'))}) GROUP BY ALL",
    "unpaired_documents": "(SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))",
    "term_sentence_freq": f"WITH RECURSIVE {SENTENCES}, {POSTS} SELECT doc_id, term, count(*)::BIGINT AS sentences FROM posts GROUP BY ALL",
    "keyword_doc_score": f"WITH RECURSIVE {SCORES} SELECT doc_id, coalesce(coverage, 0)::BIGINT AS coverage, coalesce(total, 0)::BIGINT AS total, round(coalesce(points, 0) / 20.0::DOUBLE, 6) AS score FROM docs LEFT JOIN scores USING (doc_id)",
    "keyword_doc_rank": f"WITH RECURSIVE {SCORES}, ranked AS MATERIALIZED (SELECT doc_id, points, row_number() OVER (ORDER BY points DESC, doc_id) AS rank FROM scores) SELECT rank::INT AS rank, doc_id, round(points / 20.0::DOUBLE, 6) AS score FROM ranked WHERE rank <= 20",
    "keyword_doc_share": f"WITH RECURSIVE {SCORES} SELECT doc_id, round(100.0::DOUBLE * points / nullif((SELECT sum(points) FROM scores), 0)::BIGINT, 6) AS share FROM scores",
    "keyword_sentence_count": f"WITH RECURSIVE {COUNTS} SELECT * FROM counts",
    "keyword_global_count": f"WITH RECURSIVE {COUNTS} SELECT sentence, sum(hits)::BIGINT AS hits FROM counts JOIN sents USING (doc_id, sent_id) GROUP BY sentence",
    "keyword_intersection": f"WITH RECURSIVE {HITS}, a AS (SELECT doc_id, sent_id, count(*) AS n FROM hits GROUP BY ALL), b AS (SELECT doc_id, count(DISTINCT term) AS terms FROM hits GROUP BY ALL) SELECT sentence, count(*)::BIGINT AS n FROM a JOIN b USING (doc_id) JOIN sents USING (doc_id, sent_id) WHERE a.n = terms GROUP BY sentence",
    "keyword_concat": f"WITH RECURSIVE {HITS} SELECT ord::INT AS ord, doc_id, sent_id, sentence FROM hits JOIN kw USING (term) JOIN sents USING (doc_id, sent_id)",
    "missing_keywords": f"WITH RECURSIVE {HITS} SELECT term FROM kw WHERE term NOT IN (SELECT term FROM hits)",
    "extract_keywords": f"WITH {DOCS}, c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM docs) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS r FROM c) SELECT doc_id, string_agg(term, ' ' ORDER BY r) AS keywords FROM r WHERE r <= 8 GROUP BY doc_id",
    "parse_keyword_reply": r"WITH r AS (SELECT doc_id, regexp_extract_all(CASE WHEN doc_id % 3 < 2 THEN 'Extracted: [' || source || ', ' || lang || '] associated: [' || lang || ',x]' ELSE 'only [' || source || ']' END, '\[(.*?)\]', 1) AS g FROM documents) SELECT doc_id, CASE WHEN len(g) = 2 THEN string_split(g[1], ', ') ELSE []::VARCHAR[] END AS extracted, CASE WHEN len(g) = 2 THEN string_split(g[2], ', ') ELSE []::VARCHAR[] END AS associated FROM r",
    "regex_keyword_count": f"WITH RECURSIVE {SENTENCES} SELECT * FROM (SELECT doc_id, sent_id, {WHOLE_WORDS % chr(39).join(['', 'the', ', ', 'que', ', ', 'The', ''])}::BIGINT AS hits FROM sents) WHERE hits > 0",
    "pack_context": f"WITH RECURSIVE {COUNTS}, ranked AS (SELECT * FROM counts JOIN sents USING (doc_id, sent_id)){PACKED.format(sep=1, initial=0, order='hits DESC, doc_id, sent_id', rows='ranked')} SELECT place::INT AS place, doc_id, sent_id, used::BIGINT AS used, sentence FROM packed",
    "keyword_context": f"WITH RECURSIVE {BY_DOCUMENT} SELECT place::INT AS place, doc_id, sent_id, used::BIGINT AS used, sentence FROM packed",
    "build_prompt": f"WITH RECURSIVE {BY_DOCUMENT} SELECT {quoted(context.HEADER)} || trim(string_agg(sentence, ' ' ORDER BY place)) || {quoted(context.QUESTION + QUESTION)} AS prompt FROM packed",
    "bm25_doc_score": f"WITH {DOCS}, {KW}, {bm25('text', 'doc_id')}",
    "bm25_sentence_score": f"WITH RECURSIVE {SENTENCES}, {KW}, {bm25('sentence', 'doc_id, sent_id')}",
    "associated_keywords": f"WITH RECURSIVE {ASSOCIATED} SELECT term, rank::INT AS rank, associate, cosine FROM assoc",
    "associated_doc_score": f"""WITH RECURSIVE {ASSOCIATED}, {POSTS}, more AS (SELECT term, times FROM kw UNION ALL SELECT DISTINCT associate, 1 FROM assoc),
lens AS (SELECT doc_id, term, count(*) AS n FROM posts GROUP BY ALL), scores AS (SELECT doc_id, count(*) AS coverage, sum(n * times) AS total FROM lens JOIN more USING (term) GROUP BY doc_id)
SELECT doc_id, coalesce(coverage, 0)::BIGINT AS coverage, coalesce(total, 0)::BIGINT AS total, round(coalesce(16 * coverage + total, 0)::BIGINT / 20.0::DOUBLE, 6) AS score FROM docs LEFT JOIN scores USING (doc_id)""",
    "bm25_top_documents": f"WITH {DOCS}, {KW}, {bm25_top('text', 'doc_id', 20)}",
    "bm25_top_sentences": f"WITH RECURSIVE {SENTENCES}, {KW}, {bm25_top('sentence', 'doc_id, sent_id', 20)}",
    "normalize_vectors": f"WITH {VEC} SELECT id, list_transform(v, lambda x: round(CASE WHEN n > 0 THEN x / n ELSE x END, 6)) AS v FROM (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM vecs)",
    "rep_mean": REP_ROWS,
    "rep_adaptive_pca": REP_ROWS,
    "rep_pca_kmeans": REP_ROWS,
    "elbow_k": f"WITH {VEC}, dims AS (SELECT doc, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM vecs), e AS (SELECT doc, k, round(sum(CASE WHEN i >= k THEN x * x END), 4) AS sse FROM dims, range(2, 10) r(k) GROUP BY ALL), d AS (SELECT doc, k, sse - lag(sse) OVER (PARTITION BY doc ORDER BY k) AS drop FROM e) SELECT doc, arg_min(k, (drop, k))::INT AS best_k FROM d WHERE drop IS NOT NULL GROUP BY doc",
    "cluster_weights": "SELECT label, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM embeddings)::DOUBLE, 6) AS weight FROM embeddings GROUP BY label",
    "rep_append": f"WITH {REPS} SELECT doc, (CASE WHEN doc % 2 = 0 THEN 1 ELSE 0 END)::INT AS version, (i - 1)::INT AS i, round(CASE WHEN doc % 2 = 0 THEN -x ELSE x END, 6) AS x FROM means",
    "doc_similarity_topk": f"WITH {REPS}, q AS (SELECT v FROM vecs WHERE id = 0) SELECT rank::INT AS rank, doc, round(s, 6) AS score FROM (SELECT doc, {COS.format('reps.v', 'q.v')} AS s, row_number() OVER (ORDER BY {COS.format('reps.v', 'q.v')} DESC, doc) AS rank FROM reps, q) WHERE rank <= 3",
    "knn_cosine": f"WITH {VEC}, s AS (SELECT q.id AS query_id, vecs.id, {COS.format('vecs.v', 'q.v')} AS s FROM vecs, vecs q WHERE q.id IN (0, 1, 2)) SELECT query_id, rank::INT AS rank, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) WHERE rank <= 10",
    "knn_l2": f"WITH {VEC}, s AS (SELECT q.id AS query_id, vecs.id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (vecs.v[i] - q.v[i]) * (vecs.v[i] - q.v[i]))) AS s FROM vecs, vecs q WHERE q.id IN (0, 1, 2)) SELECT query_id, rank::INT AS rank, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, id) AS rank FROM s) WHERE rank <= 5",
    "sentences_for_docs": f"WITH RECURSIVE {SCORES} SELECT doc_id, sent_id, sentence FROM sents WHERE doc_id IN (SELECT doc_id FROM scores ORDER BY points DESC, doc_id LIMIT 3)",
    "two_stage_mean": two_stage(3, 3),
    "two_stage_adaptive": two_stage(2, 100),
    "two_stage_kmeans": two_stage(3, 100),
    "two_stage_adaptive_context": asked_context(2),
    "two_stage_kmeans_context": asked_context(3),
    "stored_reps": f"WITH {REPS}, m AS (SELECT unnest(['mean', 'adaptive']) AS method) SELECT method, doc, (i - 1)::INT AS i, round(x, 6) AS x FROM means, m",
    "topic_members": f"WITH {DOCS} SELECT doc_id, source AS topic FROM docs",
    "topic_vocabulary": f"WITH {TFIDF} SELECT term, round(idf, 6) AS idf FROM vocab",
    "tfidf": f"WITH {TFIDF} SELECT doc_id, term, round(w, 6) AS w FROM weights",
    "topic_centroids": f"WITH {TFIDF} SELECT topic, term, round(w, 6) AS w FROM cents",
    "topic_match": f"WITH {MATCH} SELECT * FROM sims",
    "topic_context": "WITH RECURSIVE "
    + SENTENCES
    + ", "
    + MATCH[MATCH.index("words AS") :]  # without docs, which the sentences bring
    + f", best AS MATERIALIZED (SELECT topic FROM sims ORDER BY sim DESC, topic LIMIT 1), chosen AS (SELECT sents.*, {WHOLE_WORDS % chr(39).join(['', 'the', ', ', 'que', ''])} AS hits FROM sents JOIN docs USING (doc_id) WHERE source IN (SELECT topic FROM best)), ranked AS (SELECT * FROM chosen WHERE hits > 0)"
    + PACKED.format(sep=0, initial=len(context.HEADER), order="hits DESC, doc_id, sent_id", rows="ranked")
    + " SELECT place::INT AS place, doc_id, sent_id, sentence FROM packed",
    "embed_sentences": f"WITH RECURSIVE {SENTENCES}, {EMBEDDED} SELECT doc_id, sent_id, i, x FROM emb",
    "two_stage_question": f"WITH RECURSIVE {asked(3, 3)} SELECT rank::INT AS rank, doc_id, sent_id, round(score, 4) AS score FROM found",
    "streaming_ingest": REP_ROWS,
    "ingest_documents": f"WITH RECURSIVE {SENTENCES}, {POSTS} SELECT doc_id, term, list(sent_id ORDER BY sent_id) AS postings FROM posts WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) GROUP BY ALL",
}
ORACLES["flat_index"] = ORACLES["knn_cosine"]
