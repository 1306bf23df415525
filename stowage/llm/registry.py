"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from stowage.llm import line_dedup, mixing, near_dup, one_bit, packing, quality, sharding, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_quality": quality.op2_quality,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op4_near_duplicates": near_dup.op4_near_duplicates,
    "op6_one_bit": one_bit.op6_one_bit,
    "op7_packing": packing.op7_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}

ORACLES = {
    "op1_topk": topk.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_sharding": sharding.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
