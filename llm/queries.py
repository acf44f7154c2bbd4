"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, compression, divergence, exact_dedup, html_text, jaccard_join, line_dedup, lm, mixing, quality, substring_dedup, whitening


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_html_extraction": html_text.op2_html_extraction,
        "op3_source_mixing": mixing.op3_source_mixing,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_lm_scoring": lm.op5_lm_scoring,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_quality_classifier": compression.op12_quality_classifier,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": line_dedup.ORACLE_SQL,
        "op7_chat_formatting": chat.ORACLE_SQL,
        "op9_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_source_divergence": divergence.ORACLE_SQL,
    }
