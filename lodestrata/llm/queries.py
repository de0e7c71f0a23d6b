"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lodestrata.llm import decontaminate, hard_negatives, language_id, line_dedup, ngram_join, piece_codec, quality_rules, sequence_packing, shard_packing, source_divergence, token_counts, token_files, topk_search

QUERIES = {
    "op1_piece_codec": piece_codec.op1_piece_codec,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_counts": token_counts.op3_token_counts,
    "token_pattern_counts": token_counts.token_pattern_counts,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_shard_packing": shard_packing.op5_shard_packing,
    "op6_topk_search": topk_search.op6_topk_search,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_token_files": token_files.op9_token_files,
    "op10_language_id": language_id.op10_language_id,
    "op11_sequence_packing": sequence_packing.op11_sequence_packing,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}
ORACLES = {
    "op2_decontaminate": decontaminate.SQL,
    "token_pattern_counts": token_counts.SQL,
    "op4_ngram_join": ngram_join.SQL,
    "op6_topk_search": topk_search.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_source_divergence": source_divergence.SQL,
}
