"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from quillspark.llm import bpe, context_tree, exact_dedup, html_text, line_dedup, media, merkle, mixing, near_dedup, quality, spelling, token_store, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_html_text": html_text.op3_html_text,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_token_file": token_store.op6_token_file,
    "op7_quality": quality.op7_quality,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_media": media.op10_media,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_lm_scoring": context_tree.op12_lm_scoring,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_lm_scoring": context_tree.op12_lm_scoring,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
