"""A corpus in five stages: language, near duplicates, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet in the shared folder and read again for the next one.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import langid, mixing, neardup, pieces, secrets
from quillsift.llm.common import materialize, table


#: Documents with a smaller score go: their language has the most votes but loses a duel.
LEAST_SCORE = 0.5


def known_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language, lang being the prediction; those without a letter (und) or below LEAST_SCORE go.

    Rows of a language that the model did not learn (its texts have no letter) keep their lang.
    Where nothing could be learned, only letterless rows go, and lang stays as it is.
    Repeated rows are judged each; an empty table stays empty.
    """
    model = langid.fit(docs, F.lit(True))
    if model is None:
        return docs.where(langid.has_letter("text"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    learned = [k for codes in model.members.values() for k in codes]
    judged = F.col("id.lang").isNull() | F.col("id.lang").isin(learned)
    found = langid.identify(packed, model, id_col="row").where((F.col("lang_pred") != langid.UNKNOWN) & (~judged | (F.col("score") >= LEAST_SCORE)))
    return found.select(*[F.when(judged, F.col("lang_pred")).otherwise(F.col("id.lang")).alias(c) if c == "lang" else F.col(f"id.`{c}`") for c in docs.columns])


def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without near duplicates: five-word shingles, similarity 0.8 or more, the smallest id stays.

    Unlike texts of one id all stay, and so do rows of a null id.
    """
    return neardup.keep_one(docs)


def without_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text (null for a null text)."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight has it."""
    return mixing.repeat_documents(docs)


def encoded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text's best segmentation and whether they decode to the text, beside the other columns; a null text has no ids."""
    out = pieces.with_ids(docs)
    return out.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoded),
]

#: The language model and the segmentation are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{place}")
    return docs
