"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from strideq.llm import bpe, jaccard_join, language_id, lm_score, packing, quality_mil, quality_rules, substring_dedup, topk, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_packing": packing.op4_packing,
    "op5_bpe": bpe.op5_bpe,
    "op6_topk": topk.op6_topk,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_quality_mil": quality_mil.op8_quality_mil,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_language_id": language_id.op10_language_id,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op6_topk": topk.OP6_SQL,
}
