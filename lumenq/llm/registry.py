"""The queries of the ten operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, line_dedup, mixing, near_dedup, oracle, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.query,
        "op2_near_dedup": near_dedup.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_token_counts": token_counts.query,
        "op5_suffix_dedup": suffix_dedup.query,
        "op6_sharding": sharding.query,
        "op7_line_dedup": line_dedup.query,
        "op8_quality_rules": quality_rules.query,
        "op9_mixing": mixing.query,
        "op10_quality_classifier": quality_classifier.query,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLE)
