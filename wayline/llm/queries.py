"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, chat, embedding_dedup, exact_dedup, html_extract, lm, merkle, ngram_join, packing, periodic, pieces, quality, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_chat_format": chat.op2_chat_format,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_lm_score": lm.op4_lm_score,
    "op5_packing": packing.op5_packing,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality": quality.op10_quality,
    "op11_merkle": merkle.op11_merkle,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_chat_format": chat.OP2_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op4_lm_score": lm.OP4_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_merkle": merkle.OP11_SQL,
}
