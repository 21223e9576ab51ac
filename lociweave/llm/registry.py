"""Queries and SQL oracles of this subpackage."""

from lociweave.llm import chat_format, exact_dedup, html_text, jaccard_join, language_id, media_copies, mixing, sentencepiece_lattice, url_filter, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_warc": warc.op2_warc,
    "op3_html_text": html_text.op3_html_text,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_media_copies": media_copies.op6_media_copies,
    "op7_sentencepiece": sentencepiece_lattice.op7_sentencepiece,
    "op8_mixing": mixing.op8_mixing,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {
    "op5_chat_format": chat_format.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
