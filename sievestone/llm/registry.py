"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import bin_packing, chat_format, exact_dedup, language_id, license_scan, line_dedup, ngram_join, quality_rules, source_mixing, substring_dedup

QUERIES = {
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op9_chat_formatting": chat_format.op9_chat_formatting,
    "op3_best_fit_packing": bin_packing.op3_best_fit_packing,
    "op10_source_mixing": source_mixing.op10_source_mixing,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op1_license_scan": license_scan.op1_license_scan,
    "op5_language_id": language_id.op5_language_id,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
}

ORACLES = {
    "op10_source_mixing": source_mixing.OP10_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
