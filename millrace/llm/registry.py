"""The queries of this package by name, and their SQL."""
from __future__ import annotations

from millrace.llm import chat, decontaminate, exact_dedup, jaccard_join, language, mixing, passages, periodic, substring_dedup, suffix_dedup, tokens, toxicity, whitening

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_perspective_rotation": chat.op3_perspective_rotation,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_language_id": language.op10_language_id,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_quality": passages.op13_quality,
}
ORACLES = {"op3_perspective_rotation": chat.OP3_SQL, "op6_decontaminate": decontaminate.OP6_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
