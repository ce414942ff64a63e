"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import bpe, collision, conversations, embedding_dedup, exact_dedup, html_extract, language_id, line_dedup, mixing, near_dedup, phrases, toxicity, url_filter

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_toxicity": toxicity.query,
    "op3_source_mix": mixing.query,
    "op4_byte_bpe": bpe.query,
    "op5_language_id": language_id.query,
    "op6_line_dedup": line_dedup.query,
    "op7_url_filter": url_filter.query,
    "op8_embedding_dedup": embedding_dedup.query,
    "op9_minhash_near_dedup": near_dedup.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_nearest_vectors": collision.query,
    "op12_conversation_repair": conversations.query,
    "op13_phrase_mining": phrases.query,
}

SQL = {
    "op6_line_dedup": line_dedup.SQL,
    "op7_url_filter": url_filter.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op13_phrase_mining": phrases.SQL,
}
