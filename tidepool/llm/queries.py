"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from tidepool.llm import (
    chat, html, merkle, packing, pieces, pii, quality, repair, sharding, simhash, superminhash, topk, toxicity,
)

QUERIES: dict[str, Callable] = {
    "op1_html_main_text": html.op1_html_main_text,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_sum_of_squares_packing": packing.op3_sum_of_squares_packing,
    "op4_streaming_viterbi": pieces.op4_streaming_viterbi,
    "op5_pii": pii.op5_pii,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_threshold_top_k": topk.op7_threshold_top_k,
    "op8_extendible_sharding": sharding.op8_extendible_sharding,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_perspective_rotation": chat.op10_perspective_rotation,
    "op11_rank_convergence_viterbi": repair.op11_rank_convergence_viterbi,
    "op12_superminhash_near_dedup": superminhash.op12_superminhash_near_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE: dict[str, str] = {
    "op7_threshold_top_k": topk.OP7_SQL,
    "op8_extendible_sharding": sharding.OP8_SQL,
    "op10_perspective_rotation": chat.OP10_SQL,
    "op11_rank_convergence_viterbi": repair.OP11_SQL,
    "op12_superminhash_near_dedup": superminhash.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
