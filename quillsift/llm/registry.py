"""Queries opN_<name> of this subpackage and their DuckDB equivalents."""

from . import chat, codes, fim, imatch, langid, licenses, mixing, neardup, pieces, quality, secrets, topk, urls

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_language_id": langid.op2_language_id,
    "op3_quality": quality.op3_quality,
    "op4_imatch": imatch.op4_imatch,
    "op5_chat_format": chat.op5_chat_format,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filter": urls.op7_url_filter,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_minhash_dedup": neardup.op9_minhash_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_license_scan": licenses.op12_license_scan,
    "op13_vector_codes": codes.op13_vector_codes,
}

#: Queries that SQL can express; the others have brute-force tests.
ORACLES = {
    "op1_secret_scan": secrets.OP1_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_url_filter": urls.OP7_SQL,
    "op8_exact_topk": topk.OP8_SQL,
    "op9_minhash_dedup": neardup.OP9_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op12_license_scan": licenses.OP12_SQL,
    "op13_vector_codes": codes.OP13_SQL,
}
