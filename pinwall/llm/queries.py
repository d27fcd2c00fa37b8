"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pinwall.llm import line_dedup, media, mixing, neardup, packing, pii, substring_dedup, token_counts, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_topk": topk.op2_topk,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_minhash_neardup": neardup.op4_minhash_neardup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_pii": pii.op6_pii,
    "op7_media_columns": media.op7_media_columns,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_packing": packing.op10_packing,
}

ORACLE = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_topk": topk.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op4_minhash_neardup": neardup.OP4_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
}
