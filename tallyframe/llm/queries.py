"""The queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import forest, jaccard, mixing, oracles, packing, quality, recount, sharding, suffixes, warc, windows

QUERIES = {
    "op1_capture_index": warc.op1_capture_index,
    "op2_minimax_sharding": sharding.op2_minimax_sharding,
    "op3_adaptive_quality": quality.op3_adaptive_quality,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_projection_forest": forest.op5_projection_forest,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op8_edit_counts": recount.op8_edit_counts,
    "op9_token_group_join": jaccard.op9_token_group_join,
    "op10_compact_windows": windows.op10_compact_windows,
    "op7_hypergeometric_mix": mixing.op7_hypergeometric_mix,
}

ORACLE: dict[str, str] = {
    "op1_capture_index": oracles.CAPTURES,
    "op3_adaptive_quality": oracles.QUALITY,
    "op9_token_group_join": oracles.LINKS,
}
