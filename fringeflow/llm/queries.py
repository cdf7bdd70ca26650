"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import exact_dedup, fill_in_middle, line_dedup, lm_scoring, ngram_join, packing, pieces, quality_model, quality_rules, substring_dedup, token_counts, url_filter, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_pieces": pieces.query,
    "op3_token_counts": token_counts.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_quality_model": quality_model.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_lm_scoring": lm_scoring.query,
    "op8_packing": packing.query,
    "op9_ngram_join": ngram_join.query,
    "op10_quality_rules": quality_rules.query,
    "op11_whitening": whitening.query,
    "op12_url_filter": url_filter.query,
    "op13_fill_in_middle": fill_in_middle.query,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op12_url_filter": url_filter.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
