"""Queries of this package and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from tessella.llm import bpe, exact_dedup, lm_score, mixing, near_dedup, neighbours, pii, quality, repair, token_files, toxicity, trie, url_filter

QUERIES = {
    "op1_risk_rules": quality.op1,
    "op2_dart_minhash": near_dedup.op2,
    "op3_classifier_chain": toxicity.op3,
    "op4_deleted_interpolation": lm_score.op4,
    "op5_pii_spans": pii.op5,
    "op6_block_names": exact_dedup.op6,
    "op7_url_cascade": url_filter.op7,
    "op8_token_files": token_files.op8,
    "op9_byte_bpe": bpe.op9,
    "op10_raked_mix": mixing.op10,
    "op11_turn_repair": repair.op11,
    "op12_prefix_trie": trie.op12,
    "op13_nn_descent": neighbours.op13,
}

ORACLE_SQL = {
    "op1_risk_rules": quality.OP1_SQL,
    "op5_pii_spans": pii.OP5_SQL,
    "op6_block_names": exact_dedup.OP6_SQL,
    "op7_url_cascade": url_filter.OP7_SQL,
    "op10_raked_mix": mixing.OP10_SQL,
    "op11_turn_repair": repair.OP11_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
}
