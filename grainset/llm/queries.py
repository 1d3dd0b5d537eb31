"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from . import (
    alignment,
    decontamination,
    line_dedup,
    mixing,
    pii,
    piece_bpe,
    quality_rules,
    simhash_dedup,
    spelling,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_token_counts": token_counts.query,
    "op3_toxicity": toxicity.query,
    "op4_line_dedup": line_dedup.query,
    "op5_pii": pii.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_quality_rules": quality_rules.query,
    "op8_mixing": mixing.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_simhash_dedup": simhash_dedup.query,
    "op11_token_alignment": alignment.query,
    "op12_piece_encoding": piece_bpe.query,
    "op13_spelling_groups": spelling.query,
}

ORACLE: dict[str, str] = {}
