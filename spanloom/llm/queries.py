"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from spanloom.llm import chat, fingerprints, html_text, mixing, near_dedup, negatives, packing, quality, search, sharding, spelling, substrings, token_counts

QUERIES = {
    "op1_topk_search": search.op1_topk_search,
    "op2_html_extract": html_text.op2_html_extract,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_packing": packing.op4_packing,
    "op5_sharding": sharding.op5_sharding,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_chat_format": chat.op10_chat_format,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_document_fingerprints": fingerprints.op13_document_fingerprints,
}
ORACLE_SQL = {
    "op1_topk_search": search.OP1_SQL,
    "op7_source_mixing": mixing.OP7_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
